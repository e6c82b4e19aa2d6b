"""From archive files to tables: headers, directories, metadata, tile contents.

Bytes are fetched by range, after the plan has decided which: first 16 KiB per file, then only the directories whose tile
ids are wanted, and tile contents last, once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserix.functions.common import lng
from tesserix.operators.archive import parse_headers, with_metadata
from tesserix.operators.directory import decode_entries, decode_values, directory_issues, size_comparison, spread
from tesserix.operators.lookup import MAX_DEPTH, ROOT
from tesserix.session import cut_lineage
from tesserix.sources.archive_source import read_first_bytes
from tesserix.sources.codecs import decompress, with_values
from tesserix.sources.ranges import GAP, apart, merged


def scan_archives(spark: SparkSession, path: str, ending: str = "") -> DataFrame:
    """One row per file: header fields, ``reason`` when it is no readable archive, and the first bytes as ``blob``."""
    df = parse_headers(read_first_bytes(spark, path, ending))
    return df.withColumn("archive_id", F.xxhash64("path"))


def read_ranges(df: DataFrame, offset: str, length: str, out: str = "blob", path: str = "path", gap: int = GAP,
                read_at: str | None = None) -> DataFrame:
    """Add the bytes [offset, offset + length) of each row's file; ``read_error`` where they cannot be had.

    Rows go to tasks by file and 256 MiB stretch and are sorted, so a task reads its stretch front to back and even one
    enormous file is shared by many tasks. Ranges of a stretch that overlap or lie at most ``gap`` bytes apart are fetched by one read of
    up to ``READ_BYTES`` and cut out of it, also where a batch of rows ends between them. ``read_at`` names a column for the place where a
    row's read began.
    """
    rows = df.withColumn("_stretch", F.shiftright(F.col(offset), 28))
    rows = rows.repartition(path, "_stretch").sortWithinPartitions(path, offset).drop("_stretch")
    extra = [T.StructField(read_at, T.LongType())] if read_at else []
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType()), T.StructField("read_error", T.StringType()), *extra])

    def fetched(places: list[tuple[str, int | None, int | None]]) -> Iterator[tuple[bytes | None, str | None, int | None]]:
        """For each place, in order, its bytes, what went wrong, and where its read began."""
        from pyarrow import fs

        at = 0
        while at < len(places):
            name, end = places[at][0], at
            while end < len(places) and places[end][0] == name:
                end += 1
            mine, at = places[at:end], end
            good = [k for k, place in enumerate(mine) if not _bad(place)]
            bad = set(range(len(mine))) - set(good)
            # A file system that cannot be opened fails the job; only a file or a range can be bad data.
            system, inner = fs.FileSystem.from_uri(name)
            try:
                handle, size = (f := system.open_input_file(inner)), f.size()
            except OSError as e:
                yield from ((None, "bad-range" if k in bad else type(e).__name__, None) for k in range(len(mine)))
                continue
            with handle:
                # A declared length may be nonsense; what the file holds bounds the read.
                spans = [(min(mine[k][1], size), min(mine[k][1] + mine[k][2], size)) for k in good]
                yield from ((None, "bad-range", None) for _ in bad)  # they are first
                for start, stop, members in merged(spans, gap):
                    try:
                        data = handle.read_at(stop - start, start)
                    except OSError as e:
                        yield from ((None, type(e).__name__, start) for _ in members)
                        continue
                    for m in members:
                        a, b = spans[m]
                        yield data[a - start:b - start], None if b - a == mine[good[m]][2] else "short-read", start

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, places in _whole_reads(batches, (path, offset, length), gap):
            begins: list[int | None] = []
            values = ((v, e) for v, e, at in fetched(places) if begins.append(at) is None)
            for part in with_values(batch, values, schema.names[:-1] if read_at else schema.names):
                if read_at:
                    part = pa.RecordBatch.from_arrays([*part.columns, pa.array(begins[:part.num_rows], pa.int64())], names=schema.names)
                    del begins[:part.num_rows]
                yield part

    return rows.mapInArrow(step, schema)


Place = tuple[str, int | None, int | None]


def _bad(place: Place) -> bool:
    return place[1] is None or place[2] is None or place[1] < 0 or place[2] < 0


def _file_size(name: str) -> int | None:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(name)
    try:
        return system.get_file_info(inner).size
    except OSError:
        return None


def _whole_reads(batches: Iterator[pa.RecordBatch], columns: tuple[str, str, str], gap: int) -> Iterator[tuple[pa.RecordBatch, list[Place]]]:
    """The rows again, with their places, in batches that end where a read ends: what belongs to the last read of a batch waits for the
    next one. Ranges that cannot be read go first in their file, so that the others stay sorted."""
    held: list[tuple[pa.RecordBatch, list[Place]]] = []
    name, size, start, end = None, None, None, 0

    def given() -> tuple[pa.RecordBatch, list[Place]]:
        rows, flat = pa.Table.from_batches([b for b, _ in held]), [p for _, some in held for p in some]
        order = sorted(range(len(flat)), key=lambda i: (flat[i][0] or "", not _bad(flat[i]), flat[i][1] or 0))
        whole = rows.take(pa.array(order, pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([c.chunk(0) for c in whole.columns], schema=whole.schema), [flat[i] for i in order]

    for batch in batches:
        if not batch.num_rows:
            continue
        places = list(zip(*(batch.column(c).to_pylist() for c in columns)))
        cut = None  # where the last read of this batch begins
        for i, place in enumerate(places):
            if place[0] != name:
                name, start, cut = place[0], None, i
                size = _file_size(name)
            if _bad(place):
                continue
            a, b = min(place[1], size or 0), min(place[1] + place[2], size or 0)
            if start is None:
                start, end = a, b
            elif apart(start, end, a, b, gap):
                start, end, cut = a, b, i
            else:
                end = max(end, b)
        if start is None or start >= (size or 0):  # nothing to read, without a file or beyond its end, so nothing waits
            start, cut = None, len(places)
        if cut is None:
            held.append((batch, places))
            continue
        if cut:
            held.append((batch.slice(0, cut), places[:cut]))
        if held:
            yield given()
        held = [(batch.slice(cut), places[cut:])] if cut < len(places) else []
    if held:
        yield given()


_DIR = ["archive_id", "dir_id"]


def read_directories(archives: DataFrame, first_tile: int | None = None, end_tile: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of all readable archives, level by level, at most four.

    With a tile id range, leaves that cannot hold a tile of it are never read. ``problems`` lists rule violations and
    directories that could not be read: (archive_id, dir_id, issue, i). An empty leaf is an error, an empty root is not; a leaf
    below the deepest level is ``too-deep``, one that parents give different lengths ``conflicting-lengths``.
    """
    a = archives.filter("reason IS NULL").select("archive_id", "path", "blob", "root_offset", "root_length", "leaf_offset", "internal_compression")
    inside = F.col("root_offset") + F.col("root_length") <= F.octet_length("blob")
    base = a.select("archive_id", "path", "leaf_offset", "internal_compression")
    near = a.filter(inside).withColumns({"raw": F.expr("substring(blob, CAST(root_offset AS INT) + 1, CAST(root_length AS INT))"), "read_error": F.lit(None).cast("string")})
    far = read_ranges(a.filter(~inside).drop("blob"), "root_offset", "root_length", "raw")
    cols = [*_DIR, "path", "leaf_offset", "internal_compression", "upper", "raw", "read_error"]
    level = near.drop("blob").unionByName(far).withColumns({"dir_id": lng(ROOT), "upper": F.lit(None).cast("bigint")}).select(*cols)
    entries, problems = [], []
    for depth in range(MAX_DEPTH):
        plain = decompress(level, "raw", "internal_compression", "plain", "unpack_error")
        got = cut_lineage(decode_values(spread(plain.withColumnRenamed("plain", "blob"), _DIR)), "directories")
        rows = cut_lineage(decode_entries(got, _DIR), "entries")
        entries.append(rows.drop("delta", "code").withColumn("depth", F.lit(depth)))
        fatal = F.coalesce("read_error", "unpack_error", "error", F.when((F.col("n") == 0) & F.lit(depth > 0), "empty-leaf"))
        problems.append(got.filter(fatal.isNotNull()).select(*_DIR, fatal.alias("issue"), F.lit(None).cast("bigint").alias("i")))
        problems.append(directory_issues(got, rows, _DIR))
        leaves = rows.filter("run_length = 0")
        if depth == MAX_DEPTH - 1:
            problems.append(leaves.select("archive_id", F.col("offset").alias("dir_id"), F.lit("too-deep").alias("issue"), "i"))
            break
        if leaves.isEmpty():
            break
        nxt = rows.select(*_DIR, (F.col("i") - 1).alias("i"), F.col("tile_id").alias("_next"))
        leaves = leaves.join(nxt, [*_DIR, "i"], "left").join(got.select(*_DIR, "upper"), _DIR).withColumn("upper", F.coalesce("_next", "upper"))
        if end_tile is not None:
            leaves = leaves.filter(F.col("tile_id") < end_tile)
        if first_tile is not None:
            leaves = leaves.filter(F.col("upper").isNull() | (F.col("upper") > first_tile))
        # Parents may disagree about one leaf: the longest read and the widest interval count, and the conflict is told.
        leaves = leaves.groupBy("archive_id", F.col("offset").alias("dir_id")).agg(
            F.max("length").alias("length"), (F.min("length") != F.max("length")).alias("_differ"),
            F.when(F.count("upper") == F.count("*"), F.max("upper")).alias("upper"))
        problems.append(leaves.filter("_differ").select(*_DIR, F.lit("conflicting-lengths").alias("issue"), F.lit(None).cast("bigint").alias("i")))
        leaves = leaves.drop("_differ")
        todo = leaves.join(base, "archive_id").withColumn("_at", F.col("leaf_offset") + F.col("dir_id"))
        level = read_ranges(todo, "_at", "length", "raw").select(*cols)

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return union(entries), union(problems)


def stored_directories(archives: DataFrame, entries: DataFrame) -> DataFrame:
    """(archive_id, dir_id, path, codec, at, stored): where the directories that ``entries`` came from lie in their files."""
    a = archives.filter("reason IS NULL").select("archive_id", "path", "root_offset", "root_length", "leaf_offset", F.col("internal_compression").cast("int").alias("codec"))
    leaves = entries.filter("run_length = 0").groupBy("archive_id", F.col("offset").alias("dir_id")).agg(F.max("length").alias("stored"))
    below = leaves.join(a, "archive_id").select(*_DIR, "path", "codec", (F.col("leaf_offset") + F.col("dir_id")).alias("at"), "stored")
    return a.select("archive_id", lng(ROOT).alias("dir_id"), "path", "codec", F.col("root_offset").alias("at"), F.col("root_length").alias("stored")).unionByName(below)


def directory_sizes(archives: DataFrame, entries: DataFrame) -> DataFrame:
    """Every directory as plain rows, encoded, and as stored in its file, with the ratio of compression."""
    places = stored_directories(archives, entries)
    raw = read_ranges(places, "at", "stored", "raw")
    plain = decompress(raw.drop("read_error"), "raw", "codec", "blob", "unpack_error").filter("unpack_error IS NULL")
    return size_comparison(decode_values(plain.select(*_DIR, "stored", "blob")), _DIR, "stored")


def read_metadata(archives: DataFrame) -> DataFrame:
    """(archive_id, raw, metadata, error, meta, json_ok)"""
    a = archives.filter("reason IS NULL").select("archive_id", "path", "meta_offset", "meta_length", "internal_compression")
    raw = read_ranges(a, "meta_offset", "meta_length", "raw")
    return with_metadata(decompress(raw, "raw", "internal_compression", "metadata", "error")).select(
        "archive_id", "raw", "metadata", F.coalesce("read_error", "error").alias("error"), "meta", "json_ok")


def read_contents(archives: DataFrame, entries: DataFrame, gap: int = GAP) -> DataFrame:
    """Each stored tile content once: (archive_id, offset, length, raw, payload, error, read_at). Entries that share a content
    join it afterwards. Contents near each other come from one read, which began at ``read_at`` in the file."""
    a = archives.filter("reason IS NULL").select("archive_id", "path", "tile_offset", "tile_compression")
    wanted = entries.filter("run_length > 0").select("archive_id", "offset", "length").distinct()
    todo = wanted.join(a, "archive_id").withColumn("_at", F.col("tile_offset") + F.col("offset"))
    raw = read_ranges(todo, "_at", "length", "raw", gap=gap, read_at="read_at")
    return decompress(raw, "raw", "tile_compression").select(
        "archive_id", "offset", "length", "raw", "payload", F.coalesce("read_error", "error").alias("error"), "read_at")


def from_tms(tiles: DataFrame) -> DataFrame:
    """Tile rows (z, x, tms_y, data) counted from the south -> y counted from the north."""
    side = F.call_function("shiftleft", lng(1), F.col("z").cast("int"))
    return tiles.withColumn("y", side - 1 - F.col("tms_y")).drop("tms_y")


def write_entries(entries: DataFrame, path: str, buckets: int = 64, file_rows: int = 1 << 20) -> None:
    """Store entries sorted by (archive, tile id), in folders of many archives each.

    ``archive_bucket`` is a hash of the archive, so the number of folders does not grow with the archives; range partitioning cuts a
    dominant archive over many files, and sorted files let a reader skip all row groups but those it needs. A lookup
    states its archive's bucket (``archive_bucket``) along with the archive.
    """
    rows = entries.withColumn("archive_bucket", archive_bucket(F.col("archive_id"), buckets))
    order = ["archive_bucket", "archive_id", "tile_id"]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
     .option("maxRecordsPerFile", file_rows).partitionBy("archive_bucket").parquet(path))


def archive_bucket(archive: Column, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(archive), F.lit(buckets)).cast("int")
