"""Tile lookup: floor search, outcomes, tree walk, interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.operators import directory as D
from tesserix.operators import lookup as L
from tesserix.plans import tables as T
from tesserix.session import cut_lineage


def lookup_outcomes_by_zoom(spark: SparkSession, d: str) -> DataFrame:
    """How many requests are exact hits, run hits, misses and out of zoom, per zoom (the flagship)."""
    # Equal requests are counted before the search, so each distinct tile is looked up once.
    asked = T.requests(spark, d).groupBy("archive_id", "z", "target").agg(F.count(F.lit(1)).alias("c"))
    out = L.lookup_flat(asked, T.archives(spark, d), T.entries(spark, d))
    return out.groupBy("z", "outcome").agg(F.sum("c").alias("n"))


_OUTCOME = """CASE WHEN r.target IS NULL THEN 'invalid'
    WHEN a.archive_id IS NULL OR r.z NOT BETWEEN a.min_zoom AND a.max_zoom THEN 'out-of-zoom'
    WHEN e.tile_id IS NULL THEN 'before-first' WHEN e.tile_id = r.target AND e.run_length = 0 THEN 'exact-leaf'
    WHEN e.tile_id = r.target THEN 'exact-tile' WHEN e.run_length = 0 THEN 'leaf'
    WHEN r.target - e.tile_id < e.run_length THEN 'run-hit' ELSE 'outside-run' END"""

_ASOF = """FROM t_requests r LEFT JOIN t_archives a ON r.archive_id = a.archive_id
  ASOF LEFT JOIN t_entries e ON r.archive_id = e.archive_id AND r.target >= e.tile_id"""

LOOKUP_OUTCOMES_SQL = T.with_tables(
    f"SELECT z, outcome, count(*)::BIGINT AS n FROM (SELECT r.z, {_OUTCOME} AS outcome {_ASOF}) GROUP BY 1, 2",
    "t_requests", "t_archives", "t_entries")


def floor_entries(spark: SparkSession, d: str) -> DataFrame:
    """The entry at or before every request, without the run check."""
    out = L.floor_entry(T.requests(spark, d), T.entries(spark, d))
    return out.select("request_id", F.col("candidate.tile_id").alias("floor_tile_id"),
                      F.col("candidate.run_length").alias("floor_run_length"))


FLOOR_SQL = T.with_tables(
    f"SELECT r.request_id, e.tile_id AS floor_tile_id, e.run_length AS floor_run_length {_ASOF}",
    "t_requests", "t_archives", "t_entries")


def bucketed_lookup_equals_plain(spark: SparkSession, d: str) -> DataFrame:
    """The search cut into many small ranges, so that archives reach over several: same rows as one window per archive."""
    out = L.floor_entry(T.requests(spark, d), T.entries(spark, d), partitions=64)
    return out.groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("candidate").alias("n_found"),
        F.sum("candidate.tile_id").alias("sum_tile_id"), F.sum("candidate.run_length").alias("sum_run_length"))


BUCKETED_SQL = T.with_tables(
    f"""SELECT r.archive_id, count(*)::BIGINT AS n, count(e.tile_id)::BIGINT AS n_found,
    sum(e.tile_id)::BIGINT AS sum_tile_id, sum(e.run_length)::BIGINT AS sum_run_length {_ASOF} GROUP BY 1""",
    "t_requests", "t_archives", "t_entries")


def tree_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Root -> leaf walk over packed directories; leaf 2 of every third archive is missing, which is an error."""
    out = L.lookup_tree(T.requests(spark, d), T.archives(spark, d), _damaged(spark, d))
    return out.groupBy("archive_id", "status", "depth").agg(
        F.count(F.lit(1)).alias("n"), F.sum("offset").alias("sum_offset"), F.sum("length").alias("sum_length"))


TREE_SQL = T.with_tables("""
SELECT archive_id, status, depth, count(*)::BIGINT AS n, sum(CASE WHEN status = 'found' THEN "offset" END)::BIGINT AS sum_offset,
  sum(CASE WHEN status = 'found' THEN length END)::BIGINT AS sum_length FROM (
  SELECT r.archive_id, e."offset", e.length,
    CASE WHEN r.target IS NULL OR a.archive_id IS NULL OR r.z NOT BETWEEN a.min_zoom AND a.max_zoom OR e.tile_id IS NULL
      OR (d.leaves = 1) THEN 0 ELSE 1 END AS depth,
    CASE WHEN r.target IS NULL THEN 'invalid' WHEN a.archive_id IS NULL OR r.z NOT BETWEEN a.min_zoom AND a.max_zoom
      THEN 'out-of-zoom' WHEN e.tile_id IS NULL THEN 'not-found'
      WHEN e.leaf_no = 2 AND e.archive_id % 3 = 0 AND d.leaves > 1 THEN 'error'
      WHEN r.target - e.tile_id < e.run_length THEN 'found' ELSE 'not-found' END AS status
  FROM t_requests r LEFT JOIN t_archives a ON r.archive_id = a.archive_id
  ASOF LEFT JOIN t_numbered e ON r.archive_id = e.archive_id AND r.target >= e.tile_id
  LEFT JOIN t_leaf_dirs d ON e.archive_id = d.archive_id AND e.leaf_no = d.leaf_no)
GROUP BY 1, 2, 3""", "t_requests", "t_archives", "t_leaves")


def deep_tree_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The walk over trees of up to four levels: small leaves, packed again until the root is small."""
    tree = cut_lineage(D.pack_tree(T.placed(spark, d), 8, 64), "tree")
    out = L.lookup_tree(T.requests(spark, d), T.archives(spark, d), tree)
    return out.select("request_id", "status", "offset", "length")


DEEP_SQL = T.with_tables("""
SELECT request_id, status, CASE WHEN status = 'found' THEN "offset" END AS "offset", CASE WHEN status = 'found' THEN length END AS length FROM (
  SELECT r.request_id, e."offset", e.length, CASE WHEN r.target IS NULL THEN 'invalid'
      WHEN a.archive_id IS NULL OR r.z NOT BETWEEN a.min_zoom AND a.max_zoom THEN 'out-of-zoom'
      WHEN r.target - e.tile_id < e.run_length THEN 'found' ELSE 'not-found' END AS status
  FROM t_requests r LEFT JOIN t_archives a ON r.archive_id = a.archive_id
  ASOF LEFT JOIN t_placed e ON r.archive_id = e.archive_id AND r.target >= e.tile_id)""", "t_requests", "t_archives", "t_placed")


def hit_join(spark: SparkSession, d: str) -> DataFrame:
    """Requests answered by the flattened tree: the same hits as walking it."""
    runs = L.flatten_tree(T.leaves(spark, d)).filter("status = 'found'")
    return L.hit_join(T.requests(spark, d).filter("target IS NOT NULL"), runs).select(
        "request_id", "run_start", "run_end", "offset", "length")


HIT_SQL = T.with_tables("""
SELECT r.request_id, e.tile_id AS run_start, e.tile_id + e.run_length AS run_end, e."offset", e.length
FROM t_requests r JOIN t_placed e ON r.archive_id = e.archive_id AND r.target >= e.tile_id
  AND r.target < e.tile_id + e.run_length""", "t_requests", "t_placed")


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    """The directories without leaf 2 of every third archive."""
    return T.leaves(spark, d).filter("NOT (leaf_no = 2 AND archive_id % 3 = 0 AND dir_id >= 0)")


def flat_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The walk's answers from one interval join over the flattened tree, errors of a missing leaf included."""
    out = L.lookup_flattened(T.requests(spark, d), T.archives(spark, d), L.flatten_tree(_damaged(spark, d)))
    return out.select("request_id", "status", "offset", "length")


FLAT_SQL = T.with_tables("""
SELECT request_id, status, CASE WHEN status = 'found' THEN "offset" END AS "offset", CASE WHEN status = 'found' THEN length END AS length FROM (
  SELECT r.request_id, e."offset", e.length,
    CASE WHEN r.target IS NULL THEN 'invalid' WHEN a.archive_id IS NULL OR r.z NOT BETWEEN a.min_zoom AND a.max_zoom
      THEN 'out-of-zoom' WHEN e.tile_id IS NULL THEN 'not-found'
      WHEN e.leaf_no = 2 AND e.archive_id % 3 = 0 AND d.leaves > 1 THEN 'error'
      WHEN r.target - e.tile_id < e.run_length THEN 'found' ELSE 'not-found' END AS status
  FROM t_requests r LEFT JOIN t_archives a ON r.archive_id = a.archive_id
  ASOF LEFT JOIN t_numbered e ON r.archive_id = e.archive_id AND r.target >= e.tile_id
  LEFT JOIN t_leaf_dirs d ON e.archive_id = d.archive_id AND e.leaf_no = d.leaf_no)""", "t_requests", "t_archives", "t_leaves")


def missing_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests no run answers, per archive and zoom, those of no valid address apart."""
    runs = T.entries(spark, d).selectExpr("archive_id", "tile_id AS run_start", "tile_id + run_length AS run_end")
    asked = T.requests(spark, d)
    out = L.hit_join(asked.filter("target IS NOT NULL"), runs, "left_anti").unionByName(asked.filter("target IS NULL"))
    return out.groupBy("archive_id", "z").agg(F.count("target").alias("n_missing"), F.count_if(F.col("target").isNull()).alias("n_invalid"))


MISSING_SQL = T.with_tables("""
SELECT archive_id, z, count(target)::BIGINT AS n_missing, count(*) FILTER (WHERE target IS NULL)::BIGINT AS n_invalid
FROM t_requests r WHERE target IS NULL OR NOT EXISTS (
  SELECT 1 FROM t_tiles t WHERE t.archive_id = r.archive_id AND t.tile_id = r.target) GROUP BY 1, 2""",
                             "t_requests", "t_tiles")


def _contents(placed: DataFrame) -> DataFrame:
    """Stored contents; those of some lengths are unreadable."""
    data = F.when(F.col("length") % 5 != 0, F.encode("content", "UTF-8"))
    return placed.groupBy("archive_id", "offset", "length").agg(F.min("content").alias("content")).select(
        "archive_id", "offset", "length", data.alias("payload"), F.when(data.isNull(), "cannot decompress").alias("error"))


def map_tiles(spark: SparkSession, d: str) -> DataFrame:
    """What a map gets for each request: bytes, the missing-tile rule, or an error."""
    out = L.fetch_tiles(T.requests(spark, d), T.archives(spark, d), L.flatten_tree(_damaged(spark, d)), _contents(T.placed(spark, d)))
    return out.select("request_id", "status", "found", F.octet_length("data").cast("bigint").alias("data_length"),
                      F.md5("data").alias("data_md5"))


MAP_TILES_SQL = T.with_tables("""
SELECT request_id, CASE looked WHEN 'found' THEN CASE WHEN length % 5 = 0 THEN 'error' ELSE 'found' END ELSE looked END AS status, looked = 'found' AS found,
  CASE WHEN looked = 'found' AND length % 5 <> 0 THEN strlen(content) WHEN looked = 'missing' AND vector THEN 0 END::BIGINT AS data_length,
  CASE WHEN looked = 'found' AND length % 5 <> 0 THEN md5(content) WHEN looked = 'missing' AND vector THEN md5('') END AS data_md5 FROM (
  SELECT r.request_id, e.length, e.content, a.tile_type IN (1, 6) AS vector,
    CASE WHEN r.target IS NULL THEN 'error' WHEN a.archive_id IS NULL OR r.z NOT BETWEEN a.min_zoom AND a.max_zoom OR e.tile_id IS NULL THEN 'missing'
      WHEN e.leaf_no = 2 AND e.archive_id % 3 = 0 AND d.leaves > 1 THEN 'error'
      WHEN r.target - e.tile_id < e.run_length THEN 'found' ELSE 'missing' END AS looked
  FROM t_requests r LEFT JOIN t_archives a ON r.archive_id = a.archive_id
  ASOF LEFT JOIN t_numbered e ON r.archive_id = e.archive_id AND r.target >= e.tile_id
  LEFT JOIN t_leaf_dirs d ON e.archive_id = d.archive_id AND e.leaf_no = d.leaf_no)""", "t_requests", "t_archives", "t_leaves")


def map_request_summary(spark: SparkSession, d: str) -> DataFrame:
    """Tiles a map asked for: found, missing (known from the directory alone) and failed, with the bytes handed over."""
    return map_tiles(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("data_length").alias("bytes"))


MAP_REQUESTS_SQL = f"SELECT status, count(*)::BIGINT AS n, sum(data_length)::BIGINT AS bytes FROM ({MAP_TILES_SQL}) GROUP BY 1"


QUERIES = {
    "lookup_outcomes_by_zoom": (lookup_outcomes_by_zoom, LOOKUP_OUTCOMES_SQL),
    "floor_entries": (floor_entries, FLOOR_SQL),
    "bucketed_lookup_equals_plain": (bucketed_lookup_equals_plain, BUCKETED_SQL),
    "tree_lookup": (tree_lookup, TREE_SQL),
    "deep_tree_lookup": (deep_tree_lookup, DEEP_SQL),
    "flat_lookup": (flat_lookup, FLAT_SQL),
    "hit_join": (hit_join, HIT_SQL),
    "missing_requests": (missing_requests, MISSING_SQL),
    "map_tiles": (map_tiles, MAP_TILES_SQL),
    "map_request_summary": (map_request_summary, MAP_REQUESTS_SQL),
}
