"""Nearest neighbours by inner product: a block matrix join.

Vectors are packed into blocks of rows with 8-bit codes, and every query block meets every candidate block as one tile. The
product of the codes, with a bound on what quantisation can hide, leaves few pairs per tile; these are computed again in
double precision from the original values, and the best of each tile are merged by heaps. The bounds are proven, so the
result is exact.

Vectors that are null, all zero, or hold a null or a non-finite component take no part, on either side. Vectors only meet
others of their own length. A row is no candidate for a query of its own id; identical rows count once. Ties go to the smaller
id. Fewer than k candidates give them all; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserix.session import cut_lineage

CANDIDATE_ROWS, QUERY_ROWS = 4096, 1024
#: Pairs computed in double precision at once.
_PAIRS = 1 << 15


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, norms, norms of what the codes leave over) of the rows of ``x``."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1.0  # values so small that the division underflows
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    rest = np.linalg.norm(x - codes * scale[:, None], axis=1)
    return codes, scale, np.linalg.norm(x, axis=1), rest


def _blocks(vectors: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """One row per block of about ``rows`` vectors of one length: (dim, block, ids, x, codes, stats)."""
    count = max(1, -(-vectors.count() // rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(count)).cast("int"))

    def one(table: pa.Table) -> pa.Table:
        x = np.array(table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(table.num_rows, -1)
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        codes, *stats = quantised(x[order])
        return pa.table({"dim": [x.shape[1]], "block": [table["block"][0].as_py()], "ids": [table["id"].to_numpy()[order].tobytes()],
                         "x": [x[order].tobytes()], "codes": [codes.tobytes()], "stats": [np.stack(stats).tobytes()]},
                        schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("ids", "x", "codes", "stats"))]))

    blocks = dealt.withColumn("dim", F.size("vector")).groupBy("dim", "block").applyInArrow(
        one, "dim int, block int, ids binary, x binary, codes binary, stats binary")
    return cut_lineage(blocks, "blocks"), count


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last, so equal rows give equal values anywhere."""
    return np.cumsum(a * b, axis=1)[:, -1]


def _tile(q: tuple, c: tuple, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of a tile: (query id, ids, scores) of its best k candidates there, best first."""
    (q_ids, qx, q_codes, q_stats), (c_ids, cx, c_codes, c_stats) = q, c
    kind = np.float32 if qx.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of code products stay exact
    (qs, qn, qr), (cs, cn, cr) = q_stats, c_stats
    about = (q_codes.astype(kind) @ c_codes.astype(kind).T).astype(np.float64) * qs[:, None] * cs
    # |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'|, and a little for rounding.
    error = qr[:, None] * cn + (qn + qr)[:, None] * cr + 1e-9 * qn[:, None] * cn
    own = q_ids[:, None] == c_ids
    low = np.where(own, -np.inf, about - error)
    enough = np.full(len(q_ids), -np.inf) if len(c_ids) <= k else -np.partition(-low, k - 1, axis=1)[:, k - 1]
    qi, ci = np.nonzero((about + error >= enough[:, None]) & ~own)
    score = np.concatenate([np.zeros(0), *(_products(qx[qi[a:a + _PAIRS]], cx[ci[a:a + _PAIRS]]) for a in range(0, len(qi), _PAIRS))])
    order = np.lexsort((c_ids[ci], -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    cut = np.searchsorted(qi, np.arange(len(q_ids) + 1))
    return [(int(q_ids[i]), c_ids[ci[a:min(b, a + k)]], score[a:min(b, a + k)]) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


def _unpacked(row: dict, side: str) -> tuple[np.ndarray, ...]:
    ids = np.frombuffer(row[f"{side}_ids"], np.int64)
    shape = (len(ids), row["dim"])
    return (ids, np.frombuffer(row[f"{side}_x"], np.float64).reshape(shape), np.frombuffer(row[f"{side}_codes"], np.int8).reshape(shape),
            np.frombuffer(row[f"{side}_stats"], np.float64).reshape(3, -1))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id_column, score): the k candidates of ``vectors`` with the largest inner product, per row of ``queries``."""
    clean = [d.filter(F.col(id_column).isNotNull() & usable(vector)).select(
        F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector")).dropDuplicates() for d in (vectors, queries)]
    (cands, n), (asks, _) = _blocks(clean[0], CANDIDATE_ROWS), _blocks(clean[1], QUERY_ROWS)
    parts = ("ids", "x", "codes", "stats")
    left = asks.select("dim", *[F.col(c).alias(f"q_{c}") for c in parts], F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    right = cands.select("dim", "block", *[F.col(c).alias(f"c_{c}") for c in parts])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                best = _tile(_unpacked(row, "q"), _unpacked(row, "c"), k)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.list_(pa.int64())),
                    pa.array([b[2] for b in best], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

    runs = left.join(right, ["dim", "block"]).mapInArrow(multiply, "query_id long, ids array<long>, scores array<double>")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((q, i, s) for pdf in batches for q, i, s in zip(pdf["query_id"], pdf["ids"], pdf["scores"]))
        out: list[tuple] = []
        for query, group in groupby(rows, key=lambda r: r[0]):
            best = islice(heapq.merge(*(list(zip(-s, i)) for _, i, s in group)), k)
            out += [(query, rank, int(i), -s) for rank, (s, i) in enumerate(best, 1)]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["query_id", "rank", id_column, "score"])
                out = []
        yield pd.DataFrame(out, columns=["query_id", "rank", id_column, "score"])

    return runs.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(
        merge, f"query_id long, rank int, `{id_column}` long, score double")
