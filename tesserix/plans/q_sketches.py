"""Fleet figures from mergeable sketches, held against exact ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.operators import sketches as K
from tesserix.plans import tables as T
from tesserix.session import cut_lineage

_SHARES = (0.5, 0.9, 0.99)


def _fleet(spark: SparkSession, d: str) -> DataFrame:
    """Sketches per archive, tile type and fleet (level archive, type, fleet), merged upward."""
    rows = T.placed(spark, d).select("archive_id", F.xxhash64("content").alias("c"), F.col("tile_id").alias("v"))
    per = cut_lineage(K.sketches(rows, ["archive_id"], "c", "v"), "sketches")
    types = per.join(T.archives(spark, d).select("archive_id", "tile_type"), "archive_id", "left")
    by_type = cut_lineage(K.merged(types, ["tile_type"]), "sketches")
    out = per.select(F.lit("archive").alias("level"), F.col("archive_id").alias("name"), *per.columns[1:])
    out = out.unionByName(by_type.select(F.lit("type").alias("level"), F.col("tile_type").cast("bigint").alias("name"), *per.columns[1:]))
    return out.unionByName(K.merged(by_type, []).select(F.lit("fleet").alias("level"), F.lit(None).cast("bigint").alias("name"), *per.columns[1:]))


def fleet_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct contents and tile id quantiles of every level, with the exact figures and whether the estimates keep their bounds."""
    rows = T.placed(spark, d).select("archive_id", "content", "tile_id")
    rows = rows.join(T.archives(spark, d).select("archive_id", "tile_type"), "archive_id", "left")
    levels = F.array(F.struct(F.lit("archive").alias("level"), F.col("archive_id").alias("name")),
                     F.struct(F.lit("type").alias("level"), F.col("tile_type").cast("bigint").alias("name")),
                     F.struct(F.lit("fleet").alias("level"), F.lit(None).cast("bigint").alias("name")))
    named = rows.select("content", "tile_id", F.inline(levels))
    told = K.estimates(_fleet(spark, d), _SHARES).select("level", "name", "n_distinct", *[f"p{round(100 * s)}" for s in _SHARES])
    # Ranks of the estimates among the exact values; a row per level and name, so small beside the tiles.
    both = named.alias("r").join(told.alias("t"), F.col("r.level").eqNullSafe(F.col("t.level")) & F.col("r.name").eqNullSafe(F.col("t.name")))
    below = [f(F.col("r.tile_id"), F.col(f"t.p{round(100 * s)}")) for s in _SHARES for f in (lambda a, b: a < b, lambda a, b: a <= b)]
    got = both.groupBy("r.level", "r.name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("r.content").alias("exact_distinct"), F.max("t.n_distinct").alias("_e"),
        *[F.count_if(c).alias(f"_b{i}") for i, c in enumerate(below)])
    exact = F.col("exact_distinct")
    close = F.abs(F.col("_e") - exact) <= F.greatest(F.lit(1.0), exact * K.COUNT_ERROR)
    slack = F.col("n") * K.RANK_ERROR + 1
    ranks = [(F.col(f"_b{2 * i}") <= F.col("n") * s + slack) & (F.col(f"_b{2 * i + 1}") >= F.col("n") * s - slack) for i, s in enumerate(_SHARES)]
    return got.select("level", "name", "n", "exact_distinct", close.alias("distinct_close"), *[r.alias(f"p{round(100 * s)}_close") for r, s in zip(ranks, _SHARES)])


FLEET_SQL = T.with_tables("""
, r AS (SELECT p.*, a.tile_type FROM t_placed p LEFT JOIN t_archives a ON p.archive_id = a.archive_id),
l AS (SELECT 'archive' AS level, archive_id AS name, content FROM r UNION ALL SELECT 'type', tile_type::BIGINT, content FROM r UNION ALL SELECT 'fleet', NULL, content FROM r)
SELECT level, name, count(*)::BIGINT AS n, count(DISTINCT content)::BIGINT AS exact_distinct, TRUE AS distinct_close, TRUE AS p50_close, TRUE AS p90_close, TRUE AS p99_close
FROM l GROUP BY 1, 2""", "t_placed", "t_archives")

QUERIES = {"fleet_sketches": (fleet_sketches, FLEET_SQL)}
