"""Tables the queries run on, derived by Spark from the given parquet tables with integer formulas.

Each has a twin in SQL under the same name (``CTES``), so a query and its check start from the same rows. All grow with
their source table; archive 0 holds about a third of the tiles and requests, like one dominant archive would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.functions.address import DIGIT, NEXT, key_bits, tile_id
from tesserix.operators.directory import assign_offsets, collapse_runs, pack_leaves
from tesserix.operators.lookup import with_targets
from tesserix.session import shared_folder

#: Deepest zoom of the derived tiles; bounds their ids to 21 bits.
MAX_Z = 10
KEY_BITS = key_bits(MAX_Z)
LEAF_SIZE = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_tasks(df: DataFrame, key: str) -> DataFrame:
    """The rows spread over tasks by a unique key, for rows that are small to read but take long to compute on: Spark cuts files by
    their bytes, so such a table would be one task or few. A given number of partitions is not put together again by adaptive execution.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The derived table as a stored one, written to the shared folder on first use by this application.

    An index is built once and asked many times; the queries named after the building steps run them themselves.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _STORED:
        try:
            return spark.read.parquet(_STORED[key])
        except AnalysisException:  # the scratch folder was cleared
            del _STORED[key]
    path = shared_folder(spark, name)
    build(spark, sf_dir).write.mode("overwrite").parquet(path)
    _STORED[key] = path
    return spark.read.parquet(path)


def tile_id_sql(z: str, x: str, y: str) -> str:
    """Tile id in SQL, one level per step (the Spark side takes three)."""
    digit, nxt = (f"[{','.join(map(str, t))}]" for t in (DIGIT, NEXT))
    cell = f"((a & 3) * 4 + 2 * ((({x}) >> i) & 1) + ((({y}) >> i) & 1) + 1)"
    walk = (f"(CASE WHEN ({z}) = 0 THEN 0 ELSE list_reduce(list_prepend(0::BIGINT, range(({z})::BIGINT - 1, -1, -1)), "
            f"lambda a, i: ((a >> 2) * 4 + {digit}[{cell}]) * 4 + {nxt}[{cell}]) >> 2 END)")
    return f"((((1::BIGINT << (2 * ({z})::INTEGER)) - 1) // 3) + {walk})::BIGINT"


def build_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_tiles(archive_id, z, x, y, tile_id, content): addressed tiles, from ``orders``."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    o = o.selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 3 = 0 THEN 0L ELSE 1 + o_custkey div 500 END AS archive_id",
        "(o_orderkey div 3) % 8 AS k", "(o_orderkey div 3) div 8 AS j",
        "CASE WHEN o_totalprice < 300000 THEN o_orderstatus ELSE concat(o_orderstatus, '-', o_custkey) END AS content")
    # Every fourth archive starts at zoom 5.
    o = o.selectExpr("*", "CAST(3 + k + CASE WHEN archive_id % 4 = 1 AND k < 2 THEN 2 ELSE 0 END AS INT) AS z")
    o = o.selectExpr("o_orderkey", "archive_id", "z", "j % shiftleft(1L, z) AS x",
                     "shiftright(j, z) % shiftleft(1L, z) AS y", "content")
    o = o.groupBy("archive_id", "z", "x", "y").agg(F.min_by("content", "o_orderkey").alias("content"))
    return o.select("archive_id", "z", "x", "y", tile_id("z", "x", "y").alias("tile_id"), "content")


T_TILES = f"""
SELECT archive_id, z, x, y, {tile_id_sql('z', 'x', 'y')} AS tile_id, content FROM (
  SELECT archive_id, z, j % (1::BIGINT << z) AS x, (j >> z) % (1::BIGINT << z) AS y, arg_min(content, o_orderkey) AS content
  FROM (SELECT *, (3 + k + CASE WHEN archive_id % 4 = 1 AND k < 2 THEN 2 ELSE 0 END)::INTEGER AS z FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 + o_custkey // 500 END::BIGINT AS archive_id,
          (o_orderkey // 3) % 8 AS k, (o_orderkey // 3) // 8 AS j,
          CASE WHEN o_totalprice < 300000 THEN o_orderstatus ELSE o_orderstatus || '-' || o_custkey END AS content
        FROM orders))
  GROUP BY 1, 2, 3, 4)
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "t_requests", build_requests)


def build_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_requests(request_id, archive_id, z, x, y, valid, target): tile requests, from ``events``.

    A few lie outside the grid (x = 2^z).
    """
    e = read(spark, sf_dir, "events").select("event_id", "user_id").selectExpr(
        "event_id AS request_id", "CASE WHEN event_id % 3 = 0 THEN 0L ELSE 1 + user_id div 50 END AS archive_id",
        "CAST(2 + (event_id div 3) % 10 AS INT) AS z", "event_id div 30 AS k", "user_id")
    return with_targets(e.selectExpr(
        "request_id", "archive_id", "z",
        "CASE WHEN request_id % 211 = 0 THEN shiftleft(1L, z) ELSE (k * 31 + user_id) % shiftleft(1L, z) END AS x",
        "(k div 7 + user_id * 13) % shiftleft(1L, least(z, 4)) AS y"))


T_REQUESTS = f"""
SELECT *, x < (1::BIGINT << z) AS valid,
  CASE WHEN x < (1::BIGINT << z) THEN {tile_id_sql('z', 'x', 'y')} END AS target FROM (
  SELECT request_id, archive_id, z,
    CASE WHEN request_id % 211 = 0 THEN 1::BIGINT << z ELSE (k * 31 + user_id) % (1::BIGINT << z) END AS x,
    (k // 7 + user_id * 13) % (1::BIGINT << least(z, 4)) AS y
  FROM (SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + user_id // 50 END::BIGINT AS archive_id,
          (2 + (event_id // 3) % 10)::INTEGER AS z, event_id // 30 AS k, user_id FROM events))
"""

_ARCHIVE_COLUMNS = [  # name, formula over c = archive number and v = c % 8
    ("root_length", "100 + c % 50"),
    ("meta_length", "200 + c % 300"),
    ("leaf_length", "CASE WHEN v = 5 THEN 0 ELSE 1000 + c % 7 * 100 END"),
    ("tile_length", "50000 + c * 13 % 10000"),
]
_ARCHIVE_PLACES = [
    ("root_offset", "CASE WHEN v = 4 THEN 20000 ELSE 127 END"),
    ("leaf_offset", "127 + root_length + meta_length - CASE WHEN v = 2 THEN 10 ELSE 0 END"),
    ("tile_offset", "127 + root_length + meta_length + leaf_length + CASE WHEN v = 6 THEN 33 ELSE 0 END"),
]
_ARCHIVE_REST = [
    ("meta_offset", "CASE WHEN v = 1 THEN tile_offset + tile_length ELSE 127 + root_length END"),
    ("file_size", "CASE WHEN v = 7 THEN NULL WHEN v = 3 THEN tile_offset + tile_length - 500"
                  " WHEN v = 6 THEN tile_offset + tile_length + 77 WHEN v = 1 THEN tile_offset + tile_length + meta_length"
                  " ELSE tile_offset + tile_length END"),
    ("n_addressed", "CASE WHEN c % 9 = 8 THEN 0 ELSE 500 + c % 100 END"),
    ("n_entries", "CASE WHEN c % 9 = 8 THEN 0 ELSE 400 + c % 100 + c % 11 * 12 END"),
    ("n_contents", "CASE WHEN c % 9 = 8 THEN 0 ELSE 390 + c % 100 END"),
]
_ARCHIVE_SMALL = [
    ("spec_version", "CASE WHEN c % 53 = 52 THEN 4 ELSE 3 END"),
    ("clustered", "c % 3"),
    ("internal_compression", "c % 6"),
    ("tile_compression", "(c + 1) % 6"),
    ("tile_type", "c % 9"),
    ("min_zoom", "3"),
    ("max_zoom", "10 - c % 2"),
    ("center_zoom", "5"),
    ("min_lon_e7", "-1800000000 + c % 1000 * 100000"),
    ("min_lat_e7", "-850000000 + c % 500 * 100000"),
    ("max_lon_e7", "CASE WHEN c % 10 = 9 THEN -1800000000 ELSE 1790000000 - c % 1000 * 50000 END"),
    ("max_lat_e7", "850000000 - c % 500 * 70000"),
    ("center_lon_e7", "c % 1700 * 1000000"),
    ("center_lat_e7", "-c % 800 * 1000000"),
]


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_archives: one header per ``customer`` row. Variant v = archive_id % 8: 1 metadata last, 2 overlap, 3 beyond the
    end of the file, 4 root outside the first read, 5 empty leaf section, 6 gaps, 7 unknown file size."""
    df = read(spark, sf_dir, "customer").selectExpr("c_custkey AS archive_id", "c_custkey AS c", "c_custkey % 8 AS v")
    for group in (_ARCHIVE_COLUMNS, _ARCHIVE_PLACES, _ARCHIVE_REST):
        df = df.selectExpr("*", *[f"CAST({e} AS BIGINT) AS {n}" for n, e in group])
    return df.selectExpr("*", *[f"CAST({e} AS INT) AS {n}" for n, e in _ARCHIVE_SMALL]).drop("c", "v")


def _archives_sql() -> str:
    sql = "SELECT c_custkey AS archive_id, c_custkey AS c, c_custkey % 8 AS v FROM customer"
    for group in (_ARCHIVE_COLUMNS, _ARCHIVE_PLACES, _ARCHIVE_REST):
        sql = f"SELECT *, {', '.join(f'({e})::BIGINT AS {n}' for n, e in group)} FROM ({sql})"
    return f"SELECT *, {', '.join(f'({e})::INTEGER AS {n}' for n, e in _ARCHIVE_SMALL)} FROM ({sql})"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "t_tiles", build_tiles)


def build_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_entries(archive_id, tile_id, run_length, content)."""
    return collapse_runs(tiles(spark, sf_dir), key_bits=KEY_BITS)


T_ENTRIES = """
SELECT archive_id, min(tile_id) AS tile_id, count(*)::BIGINT AS run_length, any_value(content) AS content FROM (
  SELECT *, sum(brk) OVER (PARTITION BY archive_id ORDER BY tile_id) AS grp FROM (
    SELECT archive_id, tile_id, content, CASE WHEN lag(tile_id) OVER w + 1 = tile_id AND lag(content) OVER w = content
      THEN 0 ELSE 1 END AS brk FROM t_tiles WINDOW w AS (PARTITION BY archive_id ORDER BY tile_id)))
GROUP BY archive_id, grp
"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "t_entries", build_entries)


def build_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_placed: t_entries plus offset and length."""
    e = entries(spark, sf_dir)
    lengths = e.groupBy("archive_id", "content").agg(
        (F.max(F.length("content")) * 7 + 10).cast("bigint").alias("length"))
    return assign_offsets(e, lengths)


T_PLACED = """
SELECT e.*, c."offset", c.length FROM t_entries e JOIN (
  SELECT archive_id, content, length, coalesce(sum(length) OVER (PARTITION BY archive_id ORDER BY first_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM (
    SELECT archive_id, content, 10 + length(content) * 7 AS length, min(tile_id) AS first_id FROM t_entries GROUP BY 1, 2, 3)) c
USING (archive_id, content)
"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "t_placed", build_placed)


def build_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_leaves(archive_id, dir_id, leaf_no, i, tile_id, run_length, offset, length): t_placed cut into directories."""
    return pack_leaves(placed(spark, sf_dir), LEAF_SIZE)


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "t_leaves", build_leaves)


def _width(v: str) -> str:
    return "(" + "+".join(["1", *[f"({v} >= {128 ** k})::BIGINT" for k in range(1, 8)]]) + ")"


T_NUMBERED = f"""
SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY tile_id) - 1 AS ordinal,
  (row_number() OVER (PARTITION BY archive_id ORDER BY tile_id) - 1) // {LEAF_SIZE} AS leaf_no,
  (row_number() OVER (PARTITION BY archive_id ORDER BY tile_id) - 1) % {LEAF_SIZE} AS i FROM t_placed
"""

T_ENCODED = f"""
SELECT *, {_width('delta')} + {_width('run_length')} + {_width('length')} + {_width('code')} AS encoded_bytes FROM (
  SELECT *, tile_id - lag(tile_id, 1, 0) OVER w AS delta,
    CASE WHEN lag("offset" + length) OVER w = "offset" THEN 0 ELSE "offset" + 1 END AS code
  FROM t_numbered WINDOW w AS (PARTITION BY archive_id, leaf_no ORDER BY i))
"""

T_LEAF_DIRS = f"""
SELECT *, coalesce(sum(length) OVER (PARTITION BY archive_id ORDER BY leaf_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", count(*) OVER (PARTITION BY archive_id) AS leaves
FROM (SELECT archive_id, leaf_no, min(tile_id) AS tile_id, count(*) AS n,
        (sum(encoded_bytes) + {_width('count(*)')})::BIGINT AS length FROM t_encoded GROUP BY 1, 2)
"""

T_LEAVES = """
SELECT archive_id, -1::BIGINT AS dir_id, -1::BIGINT AS leaf_no, leaf_no AS i, tile_id, 0::BIGINT AS run_length, "offset", length
FROM t_leaf_dirs WHERE leaves > 1
UNION ALL
SELECT e.archive_id, CASE WHEN d.leaves > 1 THEN d."offset" ELSE -1 END AS dir_id, e.leaf_no, e.i, e.tile_id, e.run_length,
  e."offset", e.length
FROM t_numbered e JOIN t_leaf_dirs d ON e.archive_id = d.archive_id AND e.leaf_no = d.leaf_no
"""

#: name -> (SQL, names it needs)
CTES: dict[str, tuple[str, list[str]]] = {
    "t_tiles": (T_TILES, []),
    "t_requests": (T_REQUESTS, []),
    "t_archives": (_archives_sql(), []),
    "t_entries": (T_ENTRIES, ["t_tiles"]),
    "t_placed": (T_PLACED, ["t_entries"]),
    "t_numbered": (T_NUMBERED, ["t_placed"]),
    "t_encoded": (T_ENCODED, ["t_numbered"]),
    "t_leaf_dirs": (T_LEAF_DIRS, ["t_encoded"]),
    "t_leaves": (T_LEAVES, ["t_leaf_dirs", "t_numbered"]),
}


def with_tables(body: str, *names: str) -> str:
    """``body`` behind the definitions of the named tables and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][1]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    defs = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][0].strip()})" for n in order)
    return f"WITH {defs}\n{body.strip()}"  # a body may start with a comma and define more
