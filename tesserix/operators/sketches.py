"""Distinct counts and quantiles of many archives as sketches that merge upward: archive, then group, then fleet.

Exact distinct counts and percentiles have to see every value again at each level. A sketch is a few kilobytes per archive, computed
once beside the archive's other figures; those of a group, of a day or of the fleet come from merging sketches alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count, as bits: a standard error of about 1.04 / 2^(BITS / 2), here 1.6 %.
BITS = 12
#: Size of a quantile sketch: its ranks are within about 2.3 / K^0.9 of the true ones (under 0.5 % here) at 99 % confidence.
K = 1000
RANK_ERROR = 0.01
#: Relative error of a distinct count that is exceeded about once in a million (five standard errors).
COUNT_ERROR = 5 * 1.04 / 2 ** (BITS / 2)


def sketches(rows: DataFrame, keys: list[str], distinct: str, measure: str) -> DataFrame:
    """(keys, n, distinct_sketch, measure_sketch): partial sketches are merged before and after one shuffle by key."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, BITS).alias("distinct_sketch"),
                                   F.kll_sketch_agg_bigint(F.col(measure).cast("bigint"), K).alias("measure_sketch"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of larger groups from those of smaller ones; no keys: of everything."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
                                    F.kll_merge_agg_bigint("measure_sketch", K).alias("measure_sketch"))


def estimates(parts: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Adds ``n_distinct`` and one quantile per share (``p50`` ...)."""
    out = parts.withColumn("n_distinct", F.hll_sketch_estimate("distinct_sketch"))
    return out.withColumns({f"p{round(100 * s)}": F.kll_sketch_get_quantile_bigint("measure_sketch", F.lit(s)) for s in shares})
