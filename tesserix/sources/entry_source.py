"""Data source over the tile entries of many archives, planned from a manifest.

The manifest is a Parquet table with one row per directory that holds tile entries: archive, file, byte range, compression, least and
greatest tile id and zoom. It is sorted by (archive, least tile id) and cut into many row groups. Conditions on ``archive_id``,
``tile_id`` and ``z`` first rule out row groups by their statistics, on the driver, which never sees the directories
themselves; each remaining row group is one task, which rules out directories row by row, joins near byte ranges into one read and
decodes what is left. Conditions come from Spark's filters where the session passes them to Python sources, and otherwise from options.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
                                    LessThanOrEqual)

from tesserix.functions.address import tile_zoom
from tesserix.functions.common import lng
from tesserix.functions.varint import decode_bytes
from tesserix.sources.archive_source import can_push
from tesserix.sources.codecs import unpacked
from tesserix.sources.ranges import merged

SCHEMA = "archive_id BIGINT, dir_id BIGINT, i BIGINT, z INT, tile_id BIGINT, run_length BIGINT, offset BIGINT, length BIGINT"
#: Directories in one row group of the manifest.
GROUP_ROWS = 10000
#: Bytes of reads that a task holds at once.
_LEAST = {"archive_id": "archive_id", "tile_id": "least_tile", "z": "least_z"}
_GREATEST = {"archive_id": "archive_id", "tile_id": "greatest_tile", "z": "greatest_z"}


def write_manifest(archives: DataFrame, entries: DataFrame, folder: str, group_rows: int = GROUP_ROWS) -> None:
    """One row per directory with tile entries; ``archives`` as scanned, ``entries`` as read from their directories."""
    own = entries.filter("run_length > 0").groupBy("archive_id", "dir_id").agg(
        F.min("tile_id").alias("least_tile"), F.max(F.col("tile_id") + F.col("run_length") - 1).alias("greatest_tile"), F.count(F.lit(1)).alias("n"))
    a = archives.filter("reason IS NULL").select("archive_id", "path", "root_offset", "root_length", "leaf_offset", F.col("internal_compression").cast("int").alias("codec"))
    leaves = entries.filter("run_length = 0").groupBy("archive_id", F.col("offset").alias("dir_id")).agg(F.max("length").alias("size"))
    rows = own.join(leaves, ["archive_id", "dir_id"], "left").join(a, "archive_id")
    at = F.when(F.col("dir_id") < 0, F.col("root_offset")).otherwise(F.col("leaf_offset") + F.col("dir_id"))
    rows = rows.select("archive_id", "dir_id", "path", "codec", at.cast("bigint").alias("at"), F.coalesce("size", "root_length").cast("bigint").alias("size"),
                       "least_tile", "greatest_tile", tile_zoom("least_tile").cast("bigint").alias("least_z"), tile_zoom("greatest_tile").cast("bigint").alias("greatest_z"), lng("n").alias("n"))
    (rows.repartitionByRange("archive_id", "least_tile").sortWithinPartitions("archive_id", "least_tile")
     .write.mode("overwrite").option("maxRecordsPerFile", group_rows).parquet(folder))


class RowGroup(InputPartition):
    def __init__(self, file: str, group: int):
        super().__init__(None)
        self.file, self.group = file, group


class EntryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.conditions: list[tuple[str, str, object]] = []
        if "archive_ids" in options:
            self.conditions.append(("archive_id", "in", tuple(int(v) for v in options["archive_ids"].split(","))))
        for option, (column, sign) in {"first_tile": ("tile_id", ">="), "end_tile": ("tile_id", "<"), "min_z": ("z", ">="), "max_z": ("z", "<=")}.items():
            if option in options:
                self.conditions.append((column, sign, int(options[option])))

    def _possible(self, least, greatest):
        """Whether something between the least and greatest values, numbers or arrays per column, meets all conditions."""
        out = True
        for column, sign, value in self.conditions:
            low, high = least(_LEAST[column]), greatest(_GREATEST[column])
            if low is None or high is None:
                continue
            if sign == "in":
                found = False
                for v in value:
                    found |= (low <= v) & (high >= v)
                out &= found
            elif sign == "=":
                out &= (low <= value) & (high >= value)
            else:
                compare = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[sign]
                out &= compare(low if sign[0] == "<" else high, value)
        return out

    def _files(self):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.options["path"])
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        return system, sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))

    def partitions(self) -> list[InputPartition]:
        import pyarrow.parquet as pq

        system, files = self._files()
        out = []
        for file in files:
            meta = pq.read_metadata(file, filesystem=system)
            place = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
            for g in range(meta.num_row_groups):
                stats = {n: meta.row_group(g).column(i).statistics for n, i in place.items() if n in {*_LEAST.values(), *_GREATEST.values()}}
                stats = {n: s for n, s in stats.items() if s is not None and s.has_min_max}
                if self._possible(lambda n: stats[n].min if n in stats else None, lambda n: stats[n].max if n in stats else None):
                    out.append(RowGroup(file, g))
        return out or [RowGroup("", -1)]

    def directories(self, partition: RowGroup) -> pa.Table:
        """The manifest's rows of a row group that the conditions leave, in file order."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        # Not by listing the folder: each task would see as many files as there are tasks.
        system, _ = fs.FileSystem.from_uri(self.options["path"])
        rows = pq.ParquetFile(partition.file, filesystem=system).read_row_group(partition.group)
        values = {n: rows[n].to_numpy() for n in {*_LEAST.values(), *_GREATEST.values()}}
        keep = np.full(rows.num_rows, True) & self._possible(values.get, values.get)
        return rows.filter(pa.array(keep)).sort_by([("path", "ascending"), ("at", "ascending")])

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if partition.group < 0:
            return
        rows = self.directories(partition)
        for path in rows["path"].unique().to_pylist():
            mine = rows.filter(pa.compute.equal(rows["path"], path))
            system, inner = fs.FileSystem.from_uri(path)
            at, size = mine["at"].to_pylist(), mine["size"].to_pylist()
            with system.open_input_file(inner) as f:
                for start, end, members in merged([(a, a + n) for a, n in zip(at, size)]):
                    data = f.read_at(end - start, start)
                    for m in members:
                        blob = unpacked(data[at[m] - start:at[m] - start + size[m]], mine["codec"][m].as_py())
                        yield _entries(blob, mine["archive_id"][m].as_py(), mine["dir_id"][m].as_py())


def _entries(blob: bytes, archive: int, directory: int) -> pa.RecordBatch:
    """Tile entries of one directory: the count, then ids as differences, run lengths, lengths, offsets (0: right after the entry before)."""
    values, *_ = decode_bytes(np.frombuffer(blob, np.uint8))
    n = int(values[0])
    step, run, length, code = values[1:4 * n + 1].reshape(4, n)
    tile, before = np.cumsum(step), np.cumsum(length) - length
    told = np.maximum.accumulate(np.where((code != 0) | (np.arange(n) == 0), np.arange(n), 0))  # the last entry with an offset of its own
    offset = code[told] - 1 + before - before[told]
    bases = ((1 << (2 * np.arange(32, dtype=np.int64))) - 1) // 3
    z = np.searchsorted(bases, tile, side="right") - 1
    keep = run > 0
    columns = [np.full(n, archive), np.full(n, directory), np.arange(n), z.astype(np.int32), tile, run, offset, length]
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])


class PushingEntryReader(EntryReader):
    """Takes conditions from Spark. They only rule out directories, so Spark applies all of them to the rows as well."""

    def pushFilters(self, filters: list) -> Iterator:
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            if type(f) in signs and column in _LEAST:
                self.conditions.append((column, signs[type(f)], f.value))
            yield f


class EntrySource(DataSource):
    """``spark.read.format("tile_entries").load(manifest)``; options: archive_ids, first_tile, end_tile, min_z, max_z, push."""

    @classmethod
    def name(cls) -> str:
        return "tile_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (PushingEntryReader if options.get("push") == "true" else EntryReader)(options)


def load_entries(spark: SparkSession, manifest: str, **conditions: int | list[int]) -> DataFrame:
    """Tile entries by way of the manifest. ``conditions`` (archive_ids, first_tile, end_tile, min_z, max_z) hold in any session;
    filters on the result are passed on as well where the session allows it."""
    spark.dataSource.register(EntrySource)
    out = spark.read.format("tile_entries").option("push", str(can_push(spark)).lower())
    for name, value in conditions.items():
        out = out.option(name, ",".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value))
    rows = out.load(manifest)
    wanted = {"archive_ids": lambda v: F.col("archive_id").isin(list(v)), "first_tile": lambda v: F.col("tile_id") >= v,
              "end_tile": lambda v: F.col("tile_id") < v, "min_z": lambda v: F.col("z") >= v, "max_z": lambda v: F.col("z") <= v}
    for name, value in conditions.items():
        rows = rows.filter(wanted[name](value))
    return rows
