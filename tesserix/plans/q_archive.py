"""Archive level: headers, layout, counts, metadata, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.functions.payload import compression_name, tile_type_name
from tesserix.operators import archive as R
from tesserix.plans import tables as T

NAMES = [n for n, _, _ in R.HEADER_FIELDS]


def header_blobs(spark: SparkSession, d: str) -> DataFrame:
    """First bytes of one file per customer; some are cut short, of another kind or declare an impossible size."""
    a = T.over_tasks(T.archives(spark, d), "archive_id").withColumn("h", R.header_hex())
    c = F.col("archive_id")
    broken = (F.when(c % 17 == 3, F.expr("substring(h, 1, 252)")).when(c % 17 == 5, F.expr("concat('504D', substring(h, 5))").substr(1, 254))
              .when(c % 17 == 7, F.concat(F.lit("00"), F.expr("substring(h, 3)")))
              .when(c % 17 == 9, F.expr("concat(substring(h, 1, 28), '3F', substring(h, 31))")).otherwise(F.col("h")))
    return T.stored(spark, d, "t_header_blobs", lambda s, p: a.select("archive_id", F.unhex(broken).alias("blob")))


def parse_headers(spark: SparkSession, d: str) -> DataFrame:
    """Fields of every readable header."""
    ok, _ = R.split_headers(R.parse_headers(header_blobs(spark, d)))
    return ok.select("archive_id", *[F.col(n).cast("bigint").alias(n) for n in NAMES])


HEADERS_SQL = T.with_tables(f"SELECT archive_id, {', '.join(f'{n}::BIGINT AS {n}' for n in NAMES)} FROM t_archives "
                            "WHERE spec_version = 3 AND archive_id % 17 NOT IN (3, 7, 9)", "t_archives")


def rejected_headers(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not readable archives, by reason."""
    _, bad = R.split_headers(R.parse_headers(header_blobs(spark, d)))
    return bad.select("archive_id", "reason")


REJECTED_SQL = T.with_tables("""
SELECT archive_id, CASE archive_id % 17 WHEN 3 THEN 'too-short' WHEN 7 THEN 'wrong-magic' WHEN 9 THEN 'too-large' ELSE 'unsupported-version' END AS reason
FROM t_archives WHERE spec_version <> 3 OR archive_id % 17 IN (3, 7, 9)""", "t_archives")

T.CTES["t_sections"] = ("""
SELECT archive_id, file_size, unnest(['header', 'rootDirectory', 'metadata', 'leafDirectories', 'tileData']) AS name, unnest([0, 1, 2, 3, 4]) AS no,
  unnest([0, root_offset, meta_offset, leaf_offset, tile_offset]) AS "offset", unnest([127, root_length, meta_length, leaf_length, tile_length]) AS length,
  internal_compression, tile_compression FROM t_archives""", ["t_archives"])
T.CTES["t_cursor"] = ("""
SELECT *, coalesce(max(CASE WHEN length > 0 THEN "offset" + length ELSE 0 END) OVER w, 0) AS cursor FROM t_sections
WINDOW w AS (PARTITION BY archive_id ORDER BY "offset", length, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", ["t_sections"])
T.CTES["t_segments"] = ("""
SELECT archive_id, 'gap' AS kind, NULL AS name, cursor AS "offset", "offset" - cursor AS length FROM t_cursor WHERE "offset" > cursor
UNION ALL SELECT archive_id, 'section', name, "offset", length FROM t_sections
UNION ALL SELECT archive_id, 'gap', NULL, c, file_size - c FROM (
  SELECT archive_id, file_size, max(CASE WHEN length > 0 THEN "offset" + length ELSE 0 END) AS c FROM t_sections GROUP BY 1, 2) WHERE file_size > c""",
                        ["t_cursor"])


def archive_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections in physical order."""
    s = R.sections(T.archives(spark, d))
    return s.withColumn("position", F.col("position").cast("bigint"))


SECTIONS_SQL = T.with_tables("""SELECT archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY "offset", length, no) - 1 AS position,
  name, "offset", length FROM t_sections""", "t_sections")


def layout_segments(spark: SparkSession, d: str) -> DataFrame:
    """Sections and gaps of every file."""
    return R.layout_segments(T.archives(spark, d)).drop("position")


SEGMENTS_SQL = T.with_tables("SELECT * FROM t_segments", "t_segments")


def layout_issues(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps, sections beyond the end of the file, roots outside the first read."""
    return R.layout_issues(T.archives(spark, d))


LAYOUT_ISSUES_SQL = T.with_tables("""
SELECT archive_id, 'overlap' AS issue, name AS section, (SELECT p.name FROM t_sections p WHERE p.archive_id = c.archive_id AND p.length > 0
    AND (p."offset", p.length, p.no) < (c."offset", c.length, c.no) ORDER BY p."offset" + p.length DESC, p."offset", p.length, p.no LIMIT 1) AS previous
FROM t_cursor c WHERE "offset" < cursor AND length > 0
UNION ALL SELECT archive_id, 'beyond-eof', name, NULL FROM t_sections WHERE "offset" + length > file_size
UNION ALL SELECT archive_id, 'root-outside-first-read', 'rootDirectory', NULL FROM t_archives WHERE root_offset + root_length > 16384""",
                                  "t_cursor", "t_archives")

_COMPRESSION = "['unknown', 'none', 'gzip', 'brotli', 'zstd', 'undefined(0x05)']"


def section_table(spark: SparkSession, d: str) -> DataFrame:
    """Segments with end, share and compression."""
    return R.section_table(T.archives(spark, d)).withColumn("share", F.round("share", 9))


SECTION_TABLE_SQL = T.with_tables(f"""
SELECT s.archive_id, kind, name, "offset", length, CASE WHEN length > 0 THEN "offset" + length - 1 END AS last_byte,
  round(length / file_size::DOUBLE, 9) AS share, CASE WHEN name = 'tileData' THEN {_COMPRESSION}[tile_compression + 1]
    WHEN name IN ('rootDirectory', 'metadata', 'leafDirectories') THEN {_COMPRESSION}[internal_compression + 1] END AS compression
FROM t_segments s JOIN t_archives a ON s.archive_id = a.archive_id""", "t_segments", "t_archives")


def archive_overview(spark: SparkSession, d: str) -> DataFrame:
    """Named codes, bounds check and smallest possible size."""
    return T.archives(spark, d).select("archive_id", compression_name("internal_compression").alias("compression"),
                                       tile_type_name("tile_type").alias("tile_type_name"), R.valid_bounds().alias("bounds_ok"),
                                       R.minimum_size().alias("minimum_size"))


OVERVIEW_SQL = T.with_tables(f"""
SELECT a.archive_id, {_COMPRESSION}[internal_compression + 1] AS compression,
  ['unknown/other', 'mvt', 'png', 'jpeg', 'webp', 'avif', 'mlt', 'undefined(0x07)', 'undefined(0x08)'][tile_type + 1] AS tile_type_name,
  min_lon_e7 < max_lon_e7 AND min_lat_e7 < max_lat_e7 AND min_lon_e7 >= -1800000000 AND max_lon_e7 <= 1800000000
    AND min_lat_e7 >= -900000000 AND max_lat_e7 <= 900000000 AS bounds_ok, m AS minimum_size
FROM t_archives a JOIN (SELECT archive_id, max("offset" + length) AS m FROM t_sections GROUP BY 1) s ON a.archive_id = s.archive_id""",
                             "t_archives", "t_sections")


def counts_relation(spark: SparkSession, d: str) -> DataFrame:
    """Addressed tiles, entries and contents compared."""
    return R.counts_relation(T.archives(spark, d))


def _sign(x: str, y: str) -> str:
    return f"CASE WHEN n_addressed + n_entries + n_contents > 0 THEN ['<', '=', '>'][(sign({x} - {y}) + 2)::INTEGER] END"


COUNTS_SQL = T.with_tables(f"""
SELECT archive_id, n_addressed + n_entries + n_contents > 0 AS known, {_sign('n_addressed', 'n_entries')} AS addressed_entries,
  {_sign('n_entries', 'n_contents')} AS entries_contents, CASE WHEN u THEN n_addressed - n_entries END AS saved_by_runs,
  CASE WHEN u THEN n_entries - n_contents END AS saved_by_dedup
FROM (SELECT *, n_addressed >= n_entries AND n_entries >= n_contents AND n_contents > 0 AS u FROM t_archives)""", "t_archives")


def count_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Declared counts against the directories; archives not divisible by three declare the right numbers."""
    p = T.placed(spark, d)
    true = p.groupBy("archive_id").agg(F.sum("run_length").alias("a"), F.count(F.lit(1)).alias("e"), F.countDistinct("offset").alias("c"))
    wrong = F.when(F.col("archive_id") % 3 == 1, 1).otherwise(0)
    declared = true.select("archive_id", F.when(F.col("archive_id") % 3 == 2, 0).otherwise(F.col("a")).cast("bigint").alias("n_addressed"),
                           (F.col("e") + wrong).alias("n_entries"), F.col("c").alias("n_contents"))
    return R.reconcile_counts(p, declared)


RECONCILE_SQL = T.with_tables("""
SELECT archive_id, sum(run_length)::BIGINT AS found_addressed, count(*)::BIGINT AS found_entries, count(DISTINCT "offset")::BIGINT AS found_contents,
  CASE WHEN archive_id % 3 <> 2 THEN sum(run_length) END::BIGINT AS addressed, (count(*) + CASE WHEN archive_id % 3 = 1 THEN 1 ELSE 0 END)::BIGINT AS entries,
  count(DISTINCT "offset")::BIGINT AS contents, archive_id % 3 <> 1 AS matches FROM t_placed GROUP BY 1""", "t_placed")


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    """Archives with metadata bytes of six kinds: no JSON, two and three layers, terrain, odd layers, broken UTF-8."""
    text = F.expr("""CASE archive_id % 6 WHEN 0 THEN 'not json {'
      WHEN 1 THEN concat('{"name":"c', archive_id, '","vector_layers":[{"id":"roads"},{"id":"water', archive_id % 4, '"}],"format":"pbf"}')
      WHEN 2 THEN '{"encoding":"terrarium","name":"t"}'
      WHEN 3 THEN '{"vector_layers":[{"id":"a"},{"id":5},{"x":1}],"description":"d","generator":"g","version":"1"}'
      WHEN 4 THEN '{"vector_layers":"no","type":"overlay","attribution":"x"}' END""")
    blob = F.coalesce(F.encode(text, "UTF-8"), F.unhex(F.lit("7B22FF223A317D")))
    return T.archives(spark, d).withColumn("metadata", blob)


def metadata_keys(spark: SparkSession, d: str) -> DataFrame:
    """How many archives use each metadata key."""
    return R.metadata_keys(_metadata(spark, d)).groupBy("key", "defined").agg(F.count(F.lit(1)).alias("n"))


METADATA_SQL = """
SELECT key, key NOT IN ('format', 'generator') AS defined, count(*)::BIGINT AS n FROM (SELECT unnest(CASE c_custkey % 6
  WHEN 1 THEN ['name', 'vector_layers', 'format'] WHEN 2 THEN ['encoding', 'name']
  WHEN 3 THEN ['vector_layers', 'description', 'generator', 'version'] WHEN 4 THEN ['vector_layers', 'type', 'attribution'] ELSE [] END) AS key
FROM customer) GROUP BY 1, 2"""


def vector_layers(spark: SparkSession, d: str) -> DataFrame:
    """Declared layer ids of every archive."""
    m = R.with_metadata(_metadata(spark, d))
    return m.select("archive_id", "json_ok", F.explode_outer(R.vector_layer_ids()).alias("layer"))


VECTOR_LAYERS_SQL = """
SELECT archive_id, json_ok, CASE WHEN len(l) = 0 THEN NULL ELSE layer END AS layer FROM (
  SELECT archive_id, json_ok, l, unnest(CASE WHEN len(l) = 0 THEN [''] ELSE l END) AS layer FROM (
    SELECT c_custkey AS archive_id, c_custkey % 6 NOT IN (0, 5) AS json_ok,
      CASE c_custkey % 6 WHEN 1 THEN ['roads', 'water' || c_custkey % 4] WHEN 3 THEN ['a'] ELSE []::VARCHAR[] END AS l FROM customer))"""


def drawability(spark: SparkSession, d: str) -> DataFrame:
    """How a map can draw each archive, and why not."""
    return R.drawability(R.with_metadata(_metadata(spark, d)))


DRAW_SQL = """
SELECT archive_id, CASE WHEN t BETWEEN 2 AND 5 THEN 'raster' WHEN t IN (1, 6) AND n > 0 THEN 'vector' ELSE 'none' END AS drawn_as,
  CASE WHEN t BETWEEN 2 AND 5 THEN CASE WHEN k = 2 THEN 'encoded-elevation' END WHEN t IN (1, 6) THEN CASE WHEN n = 0 THEN 'no-layer-names' END
    ELSE 'type-not-drawable' END AS note, n AS n_layers FROM (
  SELECT c_custkey AS archive_id, c_custkey % 9 AS t, c_custkey % 6 AS k, CASE c_custkey % 6 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END::BIGINT AS n FROM customer)"""


def archive_size_choice(spark: SparkSession, d: str) -> DataFrame:
    """Which size of each archive to trust."""
    a = T.archives(spark, d).selectExpr(
        "*", "CASE WHEN archive_id % 7 = 0 THEN file_size END AS local_size",
        "CASE WHEN archive_id % 7 = 1 THEN concat('bytes 0-16383/', tile_offset + tile_length) WHEN archive_id % 7 = 2 THEN 'bytes 0-16383/*' END AS content_range",
        "CASE WHEN archive_id % 7 = 3 THEN tile_offset + tile_length END AS body_length",
        "CASE WHEN archive_id % 5 = 4 THEN NULL WHEN archive_id % 5 = 3 THEN 74037 - archive_id % 3 * 50000 ELSE tile_offset + tile_length + 1000 END AS head_length",
        "CASE WHEN archive_id % 11 = 5 THEN 'gzip' WHEN archive_id % 11 = 6 THEN 'identity' END AS head_encoding", "archive_id % 2 = 0 AS cross_origin")
    from tesserix.functions.payload import content_range_total
    out = R.archive_size(a.withColumn("range_total", content_range_total("content_range")))
    return out.select("archive_id", "origin", F.col("size").cast("bigint").alias("size"), "exact", "reason")


SIZE_SQL = T.with_tables("""
, s AS (SELECT a.*, m, CASE WHEN a.archive_id % 5 = 4 THEN NULL WHEN a.archive_id % 5 = 3 THEN 74037 - a.archive_id % 3 * 50000 ELSE tile_offset + tile_length + 1000 END AS h,
  a.archive_id % 11 = 5 AS enc, tile_offset + tile_length AS full_size, a.archive_id % 7 AS k FROM t_archives a
  JOIN (SELECT archive_id, max("offset" + length) AS m FROM t_sections GROUP BY 1) x ON a.archive_id = x.archive_id),
o AS (SELECT *, CASE WHEN k = 0 AND file_size IS NOT NULL THEN 'file' WHEN k = 1 THEN 'content-range' WHEN k = 3 THEN 'full-body'
  WHEN h IS NOT NULL AND NOT enc AND h >= m THEN 'head' ELSE 'unknown' END AS origin FROM s)
SELECT archive_id, origin, CASE origin WHEN 'file' THEN file_size WHEN 'content-range' THEN full_size WHEN 'full-body' THEN full_size WHEN 'head' THEN h END::BIGINT AS size,
  CASE origin WHEN 'head' THEN archive_id % 2 = 1 WHEN 'unknown' THEN NULL ELSE TRUE END AS exact,
  CASE WHEN origin = 'unknown' THEN CASE WHEN h IS NULL THEN 'no-length' WHEN enc THEN 'encoded' ELSE 'shorter-than-sections' END END AS reason FROM o""",
                         "t_archives", "t_sections")


QUERIES = {
    "parse_headers": (parse_headers, HEADERS_SQL),
    "rejected_headers": (rejected_headers, REJECTED_SQL),
    "archive_sections": (archive_sections, SECTIONS_SQL),
    "layout_segments": (layout_segments, SEGMENTS_SQL),
    "layout_issues": (layout_issues, LAYOUT_ISSUES_SQL),
    "section_table": (section_table, SECTION_TABLE_SQL),
    "archive_overview": (archive_overview, OVERVIEW_SQL),
    "counts_relation": (counts_relation, COUNTS_SQL),
    "count_reconciliation": (count_reconciliation, RECONCILE_SQL),
    "metadata_keys": (metadata_keys, METADATA_SQL),
    "vector_layers": (vector_layers, VECTOR_LAYERS_SQL),
    "drawability": (drawability, DRAW_SQL),
    "archive_size_choice": (archive_size_choice, SIZE_SQL),
}
