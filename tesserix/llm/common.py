"""Helpers the corpus operators share: text as bytes, words, and running sums over range partitions."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserix.session import cut_lineage

#: Text bytes handled at once in a Python worker.
CHUNK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def extended(df: DataFrame, fields: str) -> str:
    """The schema of ``df`` with further fields, as DDL."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), fields])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each value starts (one more entry than values). Null is empty."""
    column = column.cast(pa.binary()).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0]:starts[-1]], starts - starts[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column`` (or one row, if that is longer)."""
    for batch in batches:
        _, starts = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def give_back() -> None:
    """Return to the system what Arrow and the C library only keep at hand for later requests."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``step`` of mapInArrow or mapInPandas, with memory given back at its end. Spark keeps a worker for the tasks of later stages, so
    what one stage left unused would stand beside all that the next ones take."""

    @wraps(step)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def word_starts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes other than ASCII white space: begin and end of each, and the number of words per value."""
    n = len(data)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = starts[:-1][starts[:-1] < n]
    first[cut] = solid[cut]
    last = solid.copy()  # a word ends before white space or at the end of its value
    last[:-1] &= ~solid[1:]
    cut = starts[1:][starts[1:] > 0] - 1
    last[cut] = solid[cut]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.diff(np.searchsorted(begin, starts))


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd
_POWERS_STEP = 1 << 17
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = -(-n // _POWERS_STEP) * _POWERS_STEP
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        for name, base in (("up", _STEP), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial over its bytes, its length added, every bit spread."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix_bytes()[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _STEP)


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def mix_bytes() -> np.ndarray:
    return _BYTES


def fold_hashes(hashes: np.ndarray, n: int, start: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` neighbours, in order; len - n + 1 values."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, np.uint64(n + start), np.uint64)
    for k in range(n):
        out = mix(out * _STEP + hashes[k:len(hashes) - n + 1 + k])
    return out


def running(df: DataFrame, order: list[str], value: str, key: str | None = None, out: str = "start") -> DataFrame:
    """``df`` plus ``row_id`` (unique) and ``out``: the sum of ``value`` over earlier rows (of the same ``key``) in ``order``.

    One range partitioning by (key, order); each partition is scanned in place and receives what came before it from a
    table with one row per partition and key in it, at most partitions + keys rows, which is why it may be broadcast.
    No key is gathered in one task. ``key`` must not be null; the result is stored.
    """
    by = ([key] if key else []) + order

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        n, last, carry = 0, None, 0
        for pdf in batches:
            values = pdf[value].to_numpy(np.int64)
            before = np.cumsum(values) - values
            groups = pdf[key].to_numpy() if key else np.zeros(len(pdf), np.int64)
            if len(pdf):
                head = np.ones(len(pdf), bool)
                head[1:] = groups[1:] != groups[:-1]
                which = np.cumsum(head) - 1
                base = before[head]
                local = before - base[which]
                if last is not None and groups[0] == last:
                    local[which == 0] += carry
                last, carry = groups[-1], int(local[-1] + values[-1])
                yield pdf.assign(_part=part, row_id=(part << 40) + n + np.arange(len(pdf)), _local=local)
                n += len(pdf)

    schema = extended(df, "_part int, row_id long, _local long")
    placed = cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInPandas(scan, schema), "running")
    keys = ["_part"] + ([key] if key else [])
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if key:
        w = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = placed.groupBy(*keys).agg(F.sum(value).alias("_sum")).select(
        *keys, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_carry"))
    return placed.join(F.broadcast(carry), keys).withColumn(out, F.col("_local") + F.col("_carry")).drop(
        "_part", "_local", "_carry")
