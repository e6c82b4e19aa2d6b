"""Centroid clustering on integer vectors held as bit planes.

A component x becomes floor(64 x); the k-th bits of a vector's 64 integers (two's complement) are packed into one 64-bit word,
so 8 planes hold integers of 8 bits. The dot product of two vectors is the sum over pairs of planes of their weights times
popcount(plane AND plane): exact, without ever forming the components again. Sums per cluster come from the same planes, as
counts of set bits per component.

Vectors are packed once and stored; each round is one pass whose tasks send at most clusters x 65 partial sums to an aggregation,
and only the sums per cluster (16 x 64) reach the driver. All arithmetic is exact: where planes are so many that 64 bits could
overflow, whole numbers without a bound are used, and a distance beyond 63 bits is given as null.

Vectors take part if they have exactly 64 components, none null or non-finite; others are left out. Repeated rows count each.
A null id takes part but starts no centroid; equal ids start centroids in the order of their components. With fewer starts than
``k`` there are fewer centroids (with none, clusters are null). Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.session import cut_lineage

DIMS, SCALE = 64, 64
CENTROIDS, ROUNDS, SEED = 16, 3, 1
#: Vectors handled at once in a task.
BLOCK = 4096
_LIMB = 32


def taking_part(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter((F.size(v) == DIMS) & ~odd)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(64 x) as int64, or as unbounded integers where one does not fit."""
    q = np.floor(values.astype(np.float64) * SCALE)
    if np.isinf(q).any():  # 64 x is beyond the largest double; multiply as integers
        return np.array([[int(x) * SCALE if abs(x) > 2.0 ** 60 else int(np.floor(x * SCALE)) for x in row] for row in values.tolist()], object)
    if len(q) and np.abs(q).max() >= 2.0 ** 62:
        return np.array([[int(x) for x in row] for row in q.tolist()], object)
    return q.astype(np.int64)


def to_planes(numbers: np.ndarray) -> np.ndarray:
    """(vectors, planes) of uint64; the last plane is the sign."""
    if not len(numbers):
        return np.zeros((0, 1), np.uint64)
    most = max(int(numbers.max()), -int(numbers.min()) - 1, 0)
    n = most.bit_length() + 1
    planes = np.empty((len(numbers), n), np.uint64)
    for k in range(n):
        bits = ((numbers >> k) & 1).astype(np.uint8)
        planes[:, k] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return planes


def weights(n: int) -> list[int]:
    return [1 << k for k in range(n - 1)] + [-(1 << (n - 1))]


def dots(a: np.ndarray, b: np.ndarray, kind: type) -> np.ndarray:
    """Dot products of all vectors of ``a`` with all of ``b``, both as planes."""
    out = np.zeros((len(a), len(b)), kind)
    for i, u in enumerate(weights(a.shape[1])):
        for j, v in enumerate(weights(b.shape[1])):
            out += np.bitwise_count(a[:, i, None] & b[None, :, j]).astype(kind) * (u * v)
    return out


def squares(a: np.ndarray, kind: type) -> np.ndarray:
    out = np.zeros(len(a), kind)
    w = weights(a.shape[1])
    for i in range(len(w)):
        for j in range(i, len(w)):
            out += np.bitwise_count(a[:, i] & a[:, j]).astype(kind) * (w[i] * w[j] * (1 if i == j else 2))
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances (vectors, centroids), exact."""
    kind = np.int64 if 2 * max(a.shape[1], b.shape[1]) + 8 <= 62 else object
    return squares(a, kind)[:, None] - 2 * dots(a, b, kind) + squares(b, kind)[None, :]


def component_sums(planes: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Sum of each component over each cluster's vectors (k, 64), from set bits counted per component."""
    member = (cluster == np.arange(k)[:, None]).astype(np.float64)
    out = np.zeros((k, DIMS), object)
    for p, w in enumerate(weights(planes.shape[1])):
        bits = np.unpackbits(planes[:, p].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += (member @ bits).astype(np.int64).astype(object) * w
    return out


def _planes_of(column: pa.Array) -> np.ndarray:
    """The stored planes of a batch; rows with fewer planes repeat their sign."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy()[offsets[0]:offsets[-1]].view(np.uint64)
    n = np.diff(offsets)
    at = np.minimum(np.arange(n.max(initial=1))[None, :], n[:, None] - 1)
    return flat[(offsets[:-1] - offsets[0])[:, None] + at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def pack_planes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, planes) of the vectors that take part."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            planes = to_planes(whole_numbers(batch.column(1).flatten().to_numpy().reshape(-1, DIMS)))
            ends = np.arange(len(planes) + 1, dtype=np.int32) * planes.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(planes.reshape(-1).view(np.int64)))],
                                             names=["vec_id", "planes"])

    rows = taking_part(vectors, vector).select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    return rows.mapInArrow(pack, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, planes array<bigint>")


def starts(vectors: DataFrame, k: int, seed: int, vec_id: str = "vec_id", vector: str = "embedding") -> list[list[int]]:
    """The first centroids: vectors with the smallest sha256 of "seed:id". ``k`` rows reach the driver."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")).cast("binary"), 256)
    rows = taking_part(vectors, vector).select(mark.alias("mark"), F.col(vector).alias("vector")).filter("mark IS NOT NULL")
    return [whole_numbers(np.array([r.vector]))[0].tolist() for r in rows.orderBy("mark", "vector").limit(k).collect()]


def _partial_sums(centroids: list[list[int]]):
    k = len(centroids)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = to_planes(np.array(centroids, object))
        total, count = np.zeros((k, DIMS), object), np.zeros(k, np.int64)
        for batch in _blocks(batches):
            planes = _planes_of(batch.column("planes"))
            cluster = distances(planes, middle).argmin(axis=1)  # the first of equal ones
            total += component_sums(planes, cluster, k)
            count += np.bincount(cluster, minlength=k)
        rows = [(c, -1, 0, n) for c, n in enumerate(count.tolist()) if n]
        for c in np.flatnonzero(count).tolist():
            for i, left in enumerate(total[c].tolist()):
                limb = 0
                while not -(1 << _LIMB) <= left < 1 << _LIMB:  # 32 bits a row, so that no sum of rows overflows
                    rows.append((c, i, limb, left & ((1 << _LIMB) - 1)))
                    left >>= _LIMB
                    limb += 1
                rows.append((c, i, limb, left))
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         names=["cluster", "component", "limb", "value"])

    return step


def next_centroids(planes: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: means of the clusters rounded down; a centroid without vectors stays."""
    sums = planes.mapInArrow(_partial_sums(centroids), "cluster int, component int, limb int, value long")
    total = [[0] * DIMS for _ in centroids]
    count = [0] * len(centroids)
    for r in sums.groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value")).collect():  # clusters x 65, by limbs
        if r.component < 0:
            count[r.cluster] += r.value
        else:
            total[r.cluster][r.component] += r.value << (_LIMB * r.limb)
    return [[s // n for s in t] if n else old for t, n, old in zip(total, count, centroids)]


def assigned(planes: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance)."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = to_planes(np.array(centroids, object)) if centroids else None
        for batch in _blocks(batches):
            if middle is None:
                cluster = near = [None] * batch.num_rows
            else:
                d = distances(_planes_of(batch.column("planes")), middle)
                cluster = d.argmin(axis=1)
                near = [v if v < 1 << 63 else None for v in d[np.arange(len(d)), cluster].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(near, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    return planes.mapInArrow(step, f"vec_id {planes.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(assignment, final centroids)."""
    planes = cut_lineage(pack_planes(vectors), "planes")
    centroids = starts(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(planes, centroids)
    return assigned(planes, centroids), centroids


def cluster_digest(vectors: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector that takes part."""
    rows, centroids = cluster(vectors)
    rows = cut_lineage(rows, "clusters")
    spark = vectors.sparkSession
    sums = {r.cluster: r.whole for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("whole")).collect()}

    def long(total) -> int | None:
        return None if total is None or total >= 1 << 63 else int(total)

    every = None if None in sums.values() else sum(sums.values())
    mark = {c: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for c, v in enumerate(centroids)}
    each = spark.createDataFrame([(c, long(total), long(every), mark.get(c)) for c, total in sums.items()],
                                 "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(each), rows["cluster"].eqNullSafe(each["cluster"]), "left").select(  # a row per cluster
        "vec_id", rows["cluster"], "distance", "cluster_inertia", "inertia", "centroid_sha256")
