"""Archive files end to end: written from the given tables, then scanned, read and stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.plans import tables as T
from tesserix.session import cut_lineage, shared_folder
from tesserix.sources.archive_writer import write_archives, write_files
from tesserix.sources.entry_source import load_entries, write_manifest
from tesserix.sources.ingest import directory_sizes, from_tms, read_contents, read_directories, read_metadata, scan_archives, write_entries

LEAF = 64
_FOLDERS: dict[tuple[str, str], str] = {}

# One archive per 50 customers, so an archive stays small however large the tables are.
_FILE_TILES = ["o_custkey div 50 AS file_id", "o_orderkey AS tile_id", "1L AS run_length", "concat(o_orderstatus, '-', o_custkey % 5) AS content"]

F_TILES = """f_tiles AS MATERIALIZED (SELECT o_custkey // 50 AS file_id, o_orderkey AS tile_id, o_orderstatus || '-' || o_custkey % 5 AS content FROM orders),
f_contents AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file_id ORDER BY first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM (SELECT file_id, content, strlen(content) AS length, min(tile_id) AS first_id FROM f_tiles GROUP BY 1, 2)),
f_entries AS (SELECT t.file_id, t.tile_id, c."offset", c.length, t.content, count(*) OVER (PARTITION BY t.file_id) AS n
  FROM f_tiles t JOIN f_contents c ON t.file_id = c.file_id AND t.content = c.content)"""


def archives(spark: SparkSession, d: str) -> DataFrame:
    """Headers of the written files, which are written once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FOLDERS:
        folder = shared_folder(spark, "archives")
        tiles = T.read(spark, d, "orders").selectExpr(*_FILE_TILES).withColumn("content", F.encode("content", "UTF-8"))
        write_archives(tiles, "file_id", folder, LEAF).write.format("noop").mode("overwrite").save()
        _FOLDERS[key] = folder
    scanned = scan_archives(spark, _FOLDERS[key], ".tiles")
    return scanned.withColumn("file_id", F.regexp_extract("path", r"(\d+)\.tiles$", 1).cast("bigint"))


def scan_headers(spark: SparkSession, d: str) -> DataFrame:
    return archives(spark, d).select("file_id", "reason", F.col("n_entries").cast("bigint"), F.col("n_addressed").cast("bigint"),
                                     F.col("n_contents").cast("bigint"), F.col("max_zoom").cast("int"), F.col("tile_length").cast("bigint"))


HEADERS_SQL = f"""WITH {F_TILES} SELECT t.file_id, NULL::VARCHAR AS reason, n AS n_entries, n AS n_addressed, c AS n_contents, 15 AS max_zoom, l AS tile_length
FROM (SELECT file_id, count(*)::BIGINT AS n FROM f_tiles GROUP BY 1) t JOIN (
  SELECT file_id, count(*)::BIGINT AS c, sum(length)::BIGINT AS l FROM f_contents GROUP BY 1) c ON t.file_id = c.file_id"""


def _entries(spark: SparkSession, d: str, **window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    a = archives(spark, d)
    entries, problems = read_directories(a, **window)
    names = a.select("archive_id", "file_id")
    return entries.join(names, "archive_id"), problems.join(names, "archive_id"), a


def _window(spark: SparkSession, d: str) -> tuple[int, int]:
    """The middle half of all tile ids."""
    low, high = T.read(spark, d, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return low + (high - low) // 4, low + (high - low) * 3 // 4


_INSIDE = "tile_id >= (SELECT min(tile_id) + (max(tile_id) - min(tile_id)) // 4 FROM f_tiles) AND tile_id < (SELECT min(tile_id) + (max(tile_id) - min(tile_id)) * 3 // 4 FROM f_tiles)"


def scan_directories(spark: SparkSession, d: str) -> DataFrame:
    """Every tile entry of every file, and the level of the directory it stood in."""
    return _entries(spark, d)[0].filter("run_length > 0").select("file_id", "tile_id", "run_length", "offset", "length", "depth")


DIRECTORIES_SQL = f"""WITH {F_TILES} SELECT file_id, tile_id, 1::BIGINT AS run_length, "offset", length, CASE WHEN n > {LEAF} THEN 1 ELSE 0 END AS depth FROM f_entries"""


def scan_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Tile entries in a range of ids, read with the leaves outside of it left alone."""
    first, end = _window(spark, d)
    e = _entries(spark, d, first_tile=first, end_tile=end)[0]
    return e.filter((F.col("run_length") > 0) & (F.col("tile_id") >= first) & (F.col("tile_id") < end)).select("file_id", "tile_id", "offset")


PRUNED_SQL = f"""WITH {F_TILES} SELECT file_id, tile_id, "offset" FROM f_entries WHERE {_INSIDE}"""


def _manifest(spark: SparkSession, d: str) -> str:
    key = (spark.sparkContext.applicationId, f"{d} manifest")
    if key not in _FOLDERS:
        folder, names = shared_folder(spark, "manifest"), shared_folder(spark, "names")
        # Stored, as each use would list and open every file again.
        a = cut_lineage(archives(spark, d), "scanned")
        write_manifest(a, read_directories(a)[0], folder, 200)
        a.select("archive_id", "file_id").write.parquet(names)
        _FOLDERS[key], _FOLDERS[key[0], f"{d} names"] = folder, names
    return _FOLDERS[key]


def _named(spark: SparkSession, d: str, entries: DataFrame) -> DataFrame:
    names = spark.read.parquet(_FOLDERS[spark.sparkContext.applicationId, f"{d} names"])
    return entries.join(names, "archive_id").select(
        "file_id", F.col("z").cast("bigint").alias("z"), "tile_id", "run_length", "offset", "length")


def entries_by_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every tile entry, read by way of the manifest."""
    return _named(spark, d, load_entries(spark, _manifest(spark, d)))


_Z = "CASE " + " ".join(f"WHEN tile_id < {(4 ** (z + 1) - 1) // 3} THEN {z}" for z in range(14)) + " END::BIGINT"
BY_MANIFEST_SQL = f"""WITH {F_TILES} SELECT file_id, {_Z} AS z, tile_id, 1::BIGINT AS run_length, "offset", length FROM f_entries"""


def entries_in_window(spark: SparkSession, d: str) -> DataFrame:
    """The same where the deepest zoom meets a range of ids: only directories that can hold such tiles are opened."""
    first, end = _window(spark, d)
    rows = load_entries(spark, _manifest(spark, d), first_tile=first, end_tile=end)
    return _named(spark, d, rows.filter(F.col("z") >= F.lit(6)))


IN_WINDOW_SQL = f"""SELECT * FROM ({BY_MANIFEST_SQL} WHERE {_INSIDE}) WHERE z >= 6"""


def _damaged_archives(spark: SparkSession, d: str) -> DataFrame:
    """The files again: of every four, one with a broken first leaf, one cut off before its leaves, one with a broken root."""
    key = (spark.sparkContext.applicationId, f"{d} damaged")
    if key not in _FOLDERS:
        folder = shared_folder(spark, "damaged")
        heads = archives(spark, d).select("file_id", *[F.col(c).cast("int").alias(c) for c in ("root_offset", "leaf_offset", "leaf_length")])
        files = spark.read.format("binaryFile").load(_FOLDERS[spark.sparkContext.applicationId, d]).select(
            F.regexp_extract("path", r"(\d+)\.tiles$", 1).cast("bigint").alias("file_id"), "content")
        body = F.expr("""CASE file_id % 4 WHEN 1 THEN CASE WHEN leaf_length > 0 THEN overlay(content PLACING unhex(repeat('00', 8)) FROM leaf_offset + 1) ELSE content END
            WHEN 2 THEN substring(content, 1, leaf_offset) WHEN 3 THEN overlay(content PLACING unhex(repeat('00', 8)) FROM root_offset + 1) ELSE content END""")
        write_files(files.join(heads, "file_id").select("file_id", body.alias("content")), "file_id", "content", folder).write.format("noop").mode("overwrite").save()
        _FOLDERS[key] = folder
    return scan_archives(spark, _FOLDERS[key], ".tiles").withColumn("file_id", F.regexp_extract("path", r"(\d+)\.tiles$", 1).cast("bigint"))


def scan_problems(spark: SparkSession, d: str) -> DataFrame:
    """Directories that break a rule or cannot be read, per damaged file and kind."""
    a = _damaged_archives(spark, d)
    return read_directories(a)[1].join(a.select("archive_id", "file_id"), "archive_id").groupBy("file_id", "issue").agg(F.count(F.lit(1)).alias("n"))


PROBLEMS_SQL = f"""WITH {F_TILES}, n AS (SELECT file_id, count(*) AS n FROM f_tiles GROUP BY 1)
SELECT file_id, CASE WHEN file_id % 4 = 2 THEN 'short-read' ELSE 'broken' END AS issue, CASE WHEN file_id % 4 = 2 THEN (n + {LEAF} - 1) // {LEAF} ELSE 1 END::BIGINT AS n
FROM n WHERE file_id % 4 = 3 OR (file_id % 4 IN (1, 2) AND n > {LEAF})"""


def stored_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Directories with tile entries: plain, encoded and stored bytes (the last only as known and ratio as consistent)."""
    a = archives(spark, d)
    entries = read_directories(a)[0]
    first = entries.filter("run_length > 0").groupBy("archive_id", "dir_id").agg(F.min("tile_id").alias("first_tile"))
    sizes = directory_sizes(a, entries).join(first, ["archive_id", "dir_id"]).join(a.select("archive_id", "file_id"), "archive_id")
    ratio = F.abs(F.col("compression_ratio") * F.col("stored_bytes") - F.col("encoded_bytes")) < 1e-6
    return sizes.select("file_id", "first_tile", "n", "plain_bytes", "encoded_bytes", ((F.col("stored_bytes") > 0) & ratio).alias("stored_known"))


STORED_SIZES_SQL = f"""WITH {F_TILES}, e AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY tile_id) - 1 AS k FROM f_entries),
v AS (SELECT *, k // {LEAF} AS leaf, tile_id - lag(tile_id, 1, 0) OVER w AS delta, CASE WHEN lag("offset" + length) OVER w = "offset" THEN 0 ELSE "offset" + 1 END AS code
  FROM e WINDOW w AS (PARTITION BY file_id, k // {LEAF} ORDER BY k))
SELECT file_id, min(tile_id) AS first_tile, count(*)::BIGINT AS n, 24 * count(*)::BIGINT AS plain_bytes,
  (sum({T._width('delta')} + 1 + {T._width('length')} + {T._width('code')}) + {T._width('count(*)')})::BIGINT AS encoded_bytes, TRUE AS stored_known
FROM v GROUP BY file_id, leaf"""


def scan_metadata(spark: SparkSession, d: str) -> DataFrame:
    a = archives(spark, d)
    return read_metadata(a).join(a.select("archive_id", "file_id"), "archive_id").select(
        "file_id", F.decode("metadata", "UTF-8").alias("metadata"), "json_ok", "error")


METADATA_SQL = """SELECT DISTINCT o_custkey // 50 AS file_id, '{"name":"' || o_custkey // 50 || '"}' AS metadata, TRUE AS json_ok, NULL::VARCHAR AS error FROM orders"""


def scan_contents(spark: SparkSession, d: str) -> DataFrame:
    """Every stored content once, read by range."""
    entries, _, a = _entries(spark, d)
    return read_contents(a, entries).join(a.select("archive_id", "file_id"), "archive_id").select(
        "file_id", "offset", "length", F.md5("payload").alias("md5"), "error")


CONTENTS_SQL = f"""WITH {F_TILES} SELECT file_id, "offset", length, md5(content) AS md5, NULL::VARCHAR AS error FROM f_contents"""


#: Bytes between two contents that are still read together, in the query below.
NEAR = 2


def merged_reads(spark: SparkSession, d: str) -> DataFrame:
    """Contents of tiles in a range of ids: how many reads of each file fetched them, and with how many bytes."""
    first, end = _window(spark, d)
    entries, _, a = _entries(spark, d, first_tile=first, end_tile=end)
    entries = entries.filter((F.col("tile_id") >= first) & (F.col("tile_id") < end))
    got = read_contents(a, entries, gap=NEAR).join(a.select("archive_id", "file_id", "tile_offset"), "archive_id")
    reads = got.groupBy("file_id", "read_at", "tile_offset").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("offset") + F.col("length")).alias("stop"))
    return reads.groupBy("file_id").agg(F.sum("n").alias("n_contents"), F.count(F.lit(1)).alias("n_reads"),
                                        F.sum(F.col("stop") + F.col("tile_offset") - F.col("read_at")).cast("bigint").alias("bytes_read"))


MERGED_SQL = f"""WITH {F_TILES}, c AS (SELECT DISTINCT file_id, "offset", length FROM f_entries WHERE {_INSIDE}),
g AS (SELECT *, CASE WHEN "offset" <= lag("offset" + length) OVER (PARTITION BY file_id ORDER BY "offset") + {NEAR} THEN 0 ELSE 1 END AS head FROM c),
r AS (SELECT *, sum(head) OVER (PARTITION BY file_id ORDER BY "offset") AS r FROM g)
SELECT file_id, sum(n)::BIGINT AS n_contents, count(*)::BIGINT AS n_reads, sum(bytes)::BIGINT AS bytes_read FROM (
  SELECT file_id, r, count(*) AS n, max("offset" + length) - min("offset") AS bytes FROM r GROUP BY 1, 2) GROUP BY 1"""


_COLUMNS = ["archive_id", "tile_id", "run_length", "offset", "length"]


def stored_folder(spark: SparkSession, d: str) -> str:
    folder = shared_folder(spark, "stored_entries")
    write_entries(T.placed(spark, d).select(*_COLUMNS), folder)
    return folder


def stored_entries_all(spark: SparkSession, d: str) -> DataFrame:
    """Entries stored by archive bucket, every row read back."""
    return spark.read.parquet(stored_folder(spark, d)).select(*_COLUMNS)


STORED_ALL_SQL = T.with_tables('SELECT archive_id, tile_id, run_length, "offset", length FROM t_placed', "t_placed")


def stored_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every stored row, with rows, contents and bytes of its archive, both from the stored entries."""
    stored = stored_entries_all(spark, d)
    totals = stored.groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("offset").alias("n_contents"), F.sum("run_length").alias("addressed"),
        F.sum(F.col("tile_id") * 31 + F.col("offset") * 7 + F.col("length")).alias("mark"))
    return stored.join(totals, "archive_id")


STORED_SQL = T.with_tables("""SELECT archive_id, tile_id, run_length, "offset", length, n, n_contents, addressed, mark FROM t_placed JOIN (
  SELECT archive_id, count(*)::BIGINT AS n, count(DISTINCT "offset")::BIGINT AS n_contents, sum(run_length)::BIGINT AS addressed,
    sum(tile_id * 31 + "offset" * 7 + length)::BIGINT AS mark FROM t_placed GROUP BY 1) USING (archive_id)""", "t_placed")


def tms_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles whose rows count from the south, brought back to rows from the north."""
    south = T.tiles(spark, d).selectExpr("archive_id", "z", "x", "shiftleft(1L, z) - 1 - y AS tms_y")
    return from_tms(south).select("archive_id", "z", "x", "y")


TMS_SQL = T.with_tables("SELECT archive_id, z, x, y FROM t_tiles", "t_tiles")

QUERIES = {
    "scan_headers": (scan_headers, HEADERS_SQL),
    "scan_directories": (scan_directories, DIRECTORIES_SQL),
    "scan_pruned": (scan_pruned, PRUNED_SQL),
    "entries_by_manifest": (entries_by_manifest, BY_MANIFEST_SQL),
    "entries_in_window": (entries_in_window, IN_WINDOW_SQL),
    "merged_reads": (merged_reads, MERGED_SQL),
    "scan_problems": (scan_problems, PROBLEMS_SQL),
    "stored_sizes": (stored_sizes, STORED_SIZES_SQL),
    "scan_metadata": (scan_metadata, METADATA_SQL),
    "scan_contents": (scan_contents, CONTENTS_SQL),
    "stored_entries_all": (stored_entries_all, STORED_ALL_SQL),
    "stored_entries": (stored_entries, STORED_SQL),
    "tms_tiles": (tms_tiles, TMS_SQL),
}
