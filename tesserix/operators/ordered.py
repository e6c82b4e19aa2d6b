"""Ordered scans and as-of joins that never put a whole key group on one task.

A window over ``partitionBy(archive_id)`` sends a planet-sized archive to one task. Here rows are range-partitioned once by (keys,
order), so a large group is cut over many tasks, and each partition is scanned in place, Arrow batch by batch. A partition also
tells the totals of its first and last group; what a group brings along from earlier partitions is computed from these (at most
two rows per partition) and added to the rows of each partition's first group. One exchange of the rows, whatever the key's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserix.session import cut_lineage

#: carry kind (last, sum, max, min) and its value; sums and extremes are BIGINT.
Carry = tuple[str, Column]


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; nulls equal nulls."""
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


class _Running:
    """One carry over the batches of a partition: values before each row, within its group."""

    def __init__(self, kind: str, type_: pa.DataType):
        self.kind, self.held = kind, pa.nulls(1, type_)

    def before(self, values: pa.Array, head: np.ndarray, start: np.ndarray) -> pa.Array:
        n, at = len(values), np.arange(len(values))
        has = ~np.asarray(values.is_null())
        carried = np.cumsum(head) == 0  # rows of the group that the batch before ended with
        latest = np.maximum.accumulate(np.where(has, at, -1))
        latest = np.concatenate([[-1], latest[:-1]])
        local = latest >= start  # an earlier value of the group in this batch
        if self.kind == "last":
            index = np.where(local, latest + 1, 0)
            return pa.concat_arrays([self.held, values]).take(pa.array(index, mask=~local & ~carried))
        held = self.held[0].as_py()
        filled = values.fill_null({"sum": 0, "max": -(1 << 63), "min": (1 << 63) - 1}[self.kind]).to_numpy(zero_copy_only=False)
        if self.kind == "sum":
            total = np.cumsum(filled) - filled
            total = total - total[start]
        else:
            groups = pd.Series(filled).groupby(np.cumsum(head))
            total = (groups.cummax() if self.kind == "max" else groups.cummin()).to_numpy()
            total = np.concatenate([total[:1], total[:-1]])
        known = local
        if held is not None:
            join = {"sum": np.add, "max": np.maximum, "min": np.minimum}[self.kind]
            total = np.where(carried, np.where(local, join(total, held), held), total)
            known = local | carried
        return pa.array(total, pa.int64(), mask=~known) if n else values

    def upto(self, values: pa.Array, before: pa.Array, row: int) -> pa.Array:
        """The group's value with ``row`` included."""
        a, b = before.slice(row, 1), values.slice(row, 1)
        if a.null_count or b.null_count or self.kind == "last":
            return a if b.null_count else b
        a, b = a[0].as_py(), b[0].as_py()
        return pa.array([{"sum": a + b, "max": max(a, b), "min": min(a, b)}[self.kind]], pa.int64())


def _edge(template: pa.RecordBatch, keys: dict[str, pa.Array], names: list[str], totals: list[pa.Array], part: int, edge: int) -> pa.RecordBatch:
    columns = [keys[c] if c in keys else pa.nulls(1, template.schema.field(c).type) for c in template.schema.names]
    return pa.RecordBatch.from_arrays([*columns, *totals, pa.array([part], pa.int32()), pa.array([False]), pa.array([edge], pa.int32())],
                                      names=[*template.schema.names, *names, "_part", "_open", "_edge"])


def _scanner(keys: list[str], kinds: dict[str, str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, last, first, running, plain = TaskContext.get().partitionId(), -1, None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(f"_v_{name}") for name in kinds]
            plain = batch.select([c for c in batch.schema.names if not c.startswith("_v_")])
            running = running or [_Running(kind, v.type) for kind, v in zip(kinds.values(), values)]
            head = np.zeros(batch.num_rows, bool)
            for key in keys:
                head[1:] |= _changes(batch.column(key))
            here = {k: batch.column(k).slice(0, 1) for k in keys}
            head[0] = last is None or any(here[k].to_pylist() != last[k].to_pylist() for k in keys)
            if head[0] and group == 0:
                first = (last, [r.held for r in running])
            number = group + np.cumsum(head)
            start = np.maximum.accumulate(np.where(head, np.arange(batch.num_rows), 0))
            before = [r.before(v, head, start) for r, v in zip(running, values)]
            if number[-1] > 0 and number[0] == 0:
                end = int(np.searchsorted(number, 1)) - 1
                first = ({k: batch.column(k).slice(end, 1) for k in keys}, [r.upto(v, b, end) for r, v, b in zip(running, values, before)])
            for r, v, b in zip(running, values, before):
                r.held = r.upto(v, b, batch.num_rows - 1)
            group, last = int(number[-1]), {k: batch.column(k).slice(batch.num_rows - 1, 1) for k in keys}
            yield pa.RecordBatch.from_arrays([*plain.columns, *before, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(number == 0),
                                              pa.array(np.zeros(batch.num_rows, np.int32))], names=[*plain.schema.names, *kinds, "_part", "_open", "_edge"])
        if last is not None:
            totals = [r.held for r in running]
            yield _edge(plain, *((last,) if first is None else (first[0],)), list(kinds), totals if first is None else first[1], part, 1)
            if first is not None:
                yield _edge(plain, last, list(kinds), totals, part, 2)

    return scan


def _scanned(rows: DataFrame, keys: list[str], order: list[str], kinds: dict[str, str], partitions: int | None) -> DataFrame:
    """``rows`` hold a column ``_v_<name>`` per carry; it is replaced by ``<name>``, its value before each row."""
    by = [*keys, *order]
    spread = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    plain = [f for f in rows.schema.fields if not f.name.startswith("_v_")]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in plain] + [T.StructField(n, rows.schema[f"_v_{n}"].dataType) for n in kinds]
                          + [T.StructField("_part", T.IntegerType()), T.StructField("_open", T.BooleanType()), T.StructField("_edge", T.IntegerType())])
    done = cut_lineage(spread.sortWithinPartitions(*by).mapInArrow(_scanner(keys, kinds), schema), "scan")
    w = Window.partitionBy(*keys).orderBy("_part", "_edge").rowsBetween(Window.unboundedPreceding, -1)
    total = {"last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "max": F.max, "min": F.min}
    carry = done.filter("_edge > 0").select("_part", "_edge", *[total[kind](n).over(w).alias(f"_c_{n}") for n, kind in kinds.items()])
    carry = carry.filter("_edge = 1").select(F.col("_part").alias("_from"), *[f"_c_{n}" for n in kinds])
    out = done.filter("_edge = 0").withColumn("_from", F.when(F.col("_open"), F.col("_part")))
    out = out.join(F.broadcast(carry), "_from", "left")  # one row per partition

    def joined(name: str, kind: str) -> Column:
        here, held = F.col(name), F.col(f"_c_{name}")
        if kind == "sum":
            return F.coalesce(here + held, here, held)
        return F.coalesce(here, held) if kind == "last" else F.greatest(here, held) if kind == "max" else F.least(here, held)

    return out.select(*[f.name for f in plain], *[joined(n, kind).alias(n) for n, kind in kinds.items()])


def exclusive_scan(df: DataFrame, keys: list[str], order: str, carries: dict[str, Carry], partitions: int | None = None) -> DataFrame:
    """Add one column per carry, computed over the rows of the same ``keys`` with a smaller ``order`` value.

    ``carries`` maps an output name to ``(kind, value)``; kinds are ``last`` (the nearest earlier non-NULL value),
    ``sum``, ``max`` and ``min``. The first row of a group gets NULL. ``order`` should be unique within a group: equal ones are
    taken in any order. NULL keys are a group like others.
    """
    values = {f"_v_{n}": v if kind == "last" else v.cast("bigint") for n, (kind, v) in carries.items()}
    return _scanned(df.select("*", *[v.alias(n) for n, v in values.items()]), keys, [order], {n: kind for n, (kind, _) in carries.items()}, partitions)


def floor_join(left: DataFrame, right: DataFrame, on: list[str], left_key: str, right_key: str, name: str = "match",
               partitions: int | None = None) -> DataFrame:
    """As-of join: for each left row, the right row of the same ``on`` with the largest ``right_key <= left_key``.

    The right row arrives as a struct column ``name`` (NULL when there is none, or no left key). Both sides are read once and
    meet in one ordered scan: right rows come first at equal keys and are carried forward. Left rows of equal keys are
    ordered by a hash of the row, so a popular key, or many rows without one, are cut over tasks like any others.
    """
    plain = [c for c, kind in left.dtypes if "map<" not in kind]
    side, match = F.struct(*left.columns), F.struct(*[F.col(c) for c in right.columns if c not in on])
    asked = left.select(*on, F.col(left_key).cast("bigint").alias("_k"), F.lit(1).alias("_o"), F.xxhash64(*plain).alias("_s"), side.alias("_l"))
    given = right.select(*on, F.col(right_key).cast("bigint").alias("_k"), F.lit(0).alias("_o"), F.lit(0).cast("bigint").alias("_s"), match.alias("_v__m"))
    rows = asked.unionByName(given.dropna(subset=["_k", *on]), allowMissingColumns=True)
    found = _scanned(rows, on, ["_k", "_o", "_s"], {"_m": "last"}, partitions).filter("_o = 1")
    return found.select("_l.*", F.col("_m").alias(name))


def span_join(ranges: DataFrame, spans: DataFrame, on: list[str], span_start: str, span_end: str, range_start: str,
              range_end: str, partitions: int | None = None) -> DataFrame:
    """Overlap join of half-open ranges with half-open spans that are disjoint within ``on``.

    Disjoint spans are numbered in order, so the spans a range touches are one run of numbers: two floor joins find its
    ends and an equi-join fetches exactly the overlapping pairs. Work grows with the output, not with bin widths.
    """
    numbered = exclusive_scan(spans, on, span_start, {"_n": ("sum", F.lit(1))}, partitions)
    numbered = numbered.withColumn("_n", F.coalesce("_n", F.lit(0).cast("bigint")))
    index = numbered.select(*on, F.col(span_start).alias("_s"), F.col(span_end).alias("_e"), "_n")
    wanted = ranges.filter(F.col(range_end) > F.col(range_start)).withColumn("_last", F.col(range_end) - 1)
    wanted = floor_join(wanted, index, on, range_start, "_s", "_lo", partitions)
    wanted = floor_join(wanted, index, on, "_last", "_s", "_hi", partitions)
    first = F.when(F.col("_lo").isNull(), 0).when(F.col("_lo._e") > F.col(range_start), F.col("_lo._n")).otherwise(
        F.col("_lo._n") + 1)
    touched = wanted.filter(F.col("_hi").isNotNull()).withColumn("_first", first.cast("bigint"))
    touched = touched.filter(F.col("_first") <= F.col("_hi._n")).withColumn(
        "_n", F.explode(F.sequence("_first", "_hi._n"))).drop("_lo", "_hi", "_last", "_first")
    return touched.join(numbered, [*on, "_n"], "inner").drop("_n")
