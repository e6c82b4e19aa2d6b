"""Sharding along a Hilbert curve, so that each shard covers a small box of several metadata columns.

Each column is quantised into equally filled cells (approximate quantiles; whole strings, in order), the cells
of a row give its index on the curve, rows are ordered by it, and the order is cut into runs of equal row counts. Files written
this way can be skipped by filters on any of the columns.

A null, in any column, is a cell of its own before all others. Rows of one index are ordered by the hash of their text, then
by id, so equal texts of one cell stay together. Repeated rows are rows of their own. Fewer rows than shards leave shards
empty; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.llm.common import running
from tesserix.session import cut_lineage

BITS = 8


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of each row of ``cells`` (rows x dimensions, each below 2^bits).

    Bit plane by bit plane from the top: where a coordinate has the plane's bit, the lower bits of the first one are inverted,
    elsewhere they are exchanged with those of the coordinate. What remains is a Gray code of the transposed index.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for d in range(dims):
            has = (x[d] >> plane) & 1 == 1
            swap = np.where(has, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(has, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> plane) & 1 == 1, (1 << plane) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> plane) & 1)
    return out


def string_edges(df: DataFrame, column: str, bits: int = BITS) -> list[bytes]:
    """Borders between the cells of a string column: all values where there are few, else those at which equal shares of the
    rows end. At most 2^bits - 1, as nulls have a cell of their own."""
    cells = (1 << bits) - 1
    values = cut_lineage(df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n")), "values")
    distinct, rows = values.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if distinct > cells:
        share = f"least(({{}}) * {cells} div {rows}, {cells - 1})"
        values = running(values, ["_value"], "_n", out="_at").filter(f"{share.format('_at')} < {share.format('_at + _n')}")
    return sorted(r["_value"].encode() for r in values.select("_value").collect())


def with_curve(df: DataFrame, columns: list[str], bits: int = BITS, out: str = "curve") -> DataFrame:
    """``df`` plus its index on the curve over ``columns``. Reaches the driver: 2^bits borders per column."""
    strings = [c for c in columns if dict(df.dtypes)[c] == "string"]
    numbers = [c for c in columns if c not in strings]
    edges: dict = {c: string_edges(df, c, bits) for c in strings}
    if numbers:
        shares = [k / (1 << bits) for k in range(1, 1 << bits)]
        borders = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 20_000).alias(c) for c in numbers]).first()
        edges |= {c: np.unique(np.array(borders[c], float)) if borders[c] else np.zeros(0) for c in numbers}

    @F.pandas_udf("long")
    def curve(*values: pd.Series) -> pd.Series:
        cells = np.zeros((len(values[0]), len(values)), np.int64)
        for d, (v, c) in enumerate(zip(values, columns)):
            e = edges[c]
            if c in strings:
                codes, kinds = pd.factorize(v)  # a null has code -1, the last place
                at = np.array([*(bisect_left(e, k.encode()) for k in kinds), 0])[codes]
            else:
                at = np.searchsorted(e, v.to_numpy(float), side="left")
            # A column of few values fills few cells; they are spread over the whole axis.
            place = np.minimum(at + 1, (1 << bits) - 1)
            spread = ((1 << bits) - 1) // max(1, min(len(e) + 1, (1 << bits) - 1))
            cells[:, d] = np.where(v.isna(), 0, place * spread)
        return pd.Series(hilbert_index(cells, bits))

    return df.withColumn(out, curve(*[F.col(c) if c in strings else F.col(c).cast("double") for c in columns]))


def curve_shards(df: DataFrame, columns: list[str], ties: list[str], shards: int = 8, bits: int = BITS) -> DataFrame:
    """``df`` plus curve, shard and slot: runs of the curve's order, row counts at most one apart, slots gapless from 0."""
    n = df.count()
    placed = running(with_curve(df, columns, bits).withColumn("_one", F.lit(1)), ["curve", *ties], "_one", out="_rank")
    # Shard s starts at row ceil(s * n / shards).
    shard = F.expr(f"(_rank * {shards}) div {max(n, 1)}")
    placed = placed.withColumn("shard", shard.cast("int"))
    return placed.withColumn("slot", F.expr(f"_rank - (shard * {n}L + {shards - 1}) div {shards}")).drop("_one", "_rank", "row_id")


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, lang, source, size, text_crc32), stored: the text is read once."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return cut_lineage(docs.select("doc_id", "lang", "source", (F.octet_length(body) + 1).cast("long").alias("size"),
                                   F.crc32(body).alias("text_crc32")), "described")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Documents along a curve over source, language and size."""
    return curve_shards(described(docs), ["source", "lang", "size"], ["text_crc32", "doc_id"], shards)


def write_shards(docs: DataFrame, path: str, columns: list[str], shards: int = 8) -> DataFrame:
    """Writes ``docs`` as one folder per shard, rows in the order of the curve, and returns what a reader prunes by: per shard its
    rows, and the least and greatest value of each column."""
    placed = curve_shards(docs, columns, [c for c in ("doc_id",) if c in docs.columns], shards)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    ranges = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return docs.sparkSession.read.parquet(path).groupBy("shard").agg(F.count("*").alias("rows"), *ranges)


def shard_digest(docs: DataFrame) -> DataFrame:
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                        F.lit(None).cast("int").alias("grown_shard"), "curve")
