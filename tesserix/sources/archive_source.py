"""Data source over a folder of archives: one row per file with its first 16 KiB.

Files are opened through pyarrow's file systems, so a path may be local or on an object store. Only the first bytes are
read, whatever the size of the file; where the session passes filters to Python sources, conditions on ``path`` (the full address)
are applied before any file is opened, elsewhere Spark applies them to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

FIRST_READ = 16384
SCHEMA = "path STRING, file_size BIGINT, blob BINARY"


class FileGroup(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(None)
        self.files = files


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.conditions: list = []

    def _wanted(self, path: str) -> bool:
        def holds(f) -> bool:
            if isinstance(f, In):
                return path in f.value
            return path == f.value if isinstance(f, EqualTo) else path.startswith(f.value)

        return all(holds(f) for f in self.conditions)

    def _around(self, base: str) -> tuple[str, str]:
        """What stands before and after the folder in the given address, so that a file's address keeps scheme and options."""
        at = self.options["path"].find(base.rstrip("/"))
        return ("", "") if at < 0 else (self.options["path"][:at], self.options["path"][at + len(base.rstrip("/")):].lstrip("/"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.options["path"])
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        ending = self.options.get("ending", "")
        before, after = self._around(base)
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(ending) and self._wanted(before + f.path + after))
        # One group per task: opening a file costs more than its 16 KiB.
        size = int(self.options.get("filesPerTask", "256"))
        return [FileGroup(files[i:i + size]) for i in range(0, len(files), size)] or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.options["path"])
        before, after = self._around(base)
        rows = []
        for path, size in partition.files:
            with system.open_input_file(path) as f:
                rows.append((before + path + after, size, f.read_at(min(FIRST_READ, size), 0)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
            names=["path", "file_size", "blob"])


class PushingArchiveReader(ArchiveReader):
    """Spark refuses readers that take filters unless its setting is on, so this is a class of its own."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("path",):
                self.conditions.append(f)
            else:
                yield f


def can_push(spark: SparkSession) -> bool:
    return spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower() == "true"


class ArchiveSource(DataSource):
    """``spark.read.format("tile_archives").option("path", ...)``; options: ending, filesPerTask, push."""

    @classmethod
    def name(cls) -> str:
        return "tile_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (PushingArchiveReader if options.get("push") == "true" else ArchiveReader)(options)


def read_first_bytes(spark: SparkSession, path: str, ending: str = "") -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("tile_archives").option("ending", ending).option("push", str(can_push(spark)).lower()).load(path)
