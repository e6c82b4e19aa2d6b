"""Language-model scores of documents by stupid backoff, the corpus itself being the model.

Count tables of n-grams are partitioned by hash: each shard of documents sends its distinct n-grams and their counts to the
partition that owns them, is answered with the counts over the whole corpus, and sums the scores of its documents. What a
document itself adds to a count is taken off, so it is scored by all others. A word scores count(n-gram) / count(its first
n - 1 words) where the n-gram occurs elsewhere, otherwise BACKOFF times the score one word shorter; a word that no other document
holds counts half a time.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. Null and empty texts have no words and no mean
score. Repeated rows are documents of their own, so copies support each other. Extra columns are ignored; an empty table
gives no rows. Shards of documents bound what is held at once (``shard``; by default a hash of the id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserix.llm.common import chunks, fold_hashes, utf8, word_hashes, word_starts
from tesserix.session import cut_lineage

BACKOFF = 0.4
ORDER = 2
SHARD_ROWS = 2048
#: n-grams of one order in one partition of the count tables, about.
BUCKET_GRAMS = 1 << 20
_HELD_BYTES = 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(data: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(words of each document; hashes of the n-grams that end at each word, for n = 1..order; whether there is one)."""
    data = _LOWER[data]
    begin, end, counts = word_starts(data, starts)
    words = word_hashes(data, begin, end)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes, there = [words], [np.ones(len(words), bool)]
    for n in range(2, order + 1):
        h = np.zeros(len(words), np.uint64)
        if len(words) >= n:
            h[n - 1:] = fold_hashes(words, n)
        hashes.append(h)
        there.append(place >= n - 1)
    return counts, hashes, there


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, each in as many bytes as the largest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(
        steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(raw, np.uint8, 8, 1)
    steps[1:, :width] = body
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest needs (1, 2, 4 or 8): most n-grams are rare."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(counts.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _parts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys; the bucket is the key's first bits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    yield from zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)])


def _sent(texts: DataFrame, order: int, bits: int) -> DataFrame:
    """(n, bucket, shard, keys, counts): distinct n-grams of a shard's documents, by the partition that counts them."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        size = 0

        def told() -> pa.RecordBatch:
            rows = []
            for shard, parts in held.items():
                for n in range(order):
                    keys, counts = np.unique(np.concatenate([p[n] for p in parts]), return_counts=True)
                    rows += [(n + 1, b, shard, pack_sorted(keys[a:e]), pack_counts(counts[a:e])) for b, a, e in _parts(keys, bits)]
            held.clear()
            columns = list(zip(*rows)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (
                pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["n", "bucket", "shard", "keys", "counts"])

        for batch in chunks(batches, "text"):
            shards = batch.column("shard").to_numpy()
            data, starts = utf8(batch.column("text"))
            counts, hashes, there = grams(data, starts, order)
            owner = np.repeat(shards, counts)
            for shard in np.unique(shards).tolist():
                mine = owner == shard
                held.setdefault(shard, []).append([h[mine & t] for h, t in zip(hashes, there)])
            size += len(data)
            if size >= _HELD_BYTES:
                yield told()
                size = 0
        if held:
            yield told()

    return texts.select("shard", "text").mapInArrow(send, "n int, bucket int, shard long, keys binary, counts binary")


def _answered(table: pa.Table) -> pa.Table:
    """One partition of a count table: for each shard the corpus counts of its n-grams there, in the order of its keys."""
    own: dict[int, list[np.ndarray]] = {}
    keys = [unpack_sorted(k) for k in table["keys"].to_pylist()]
    for shard, k in zip(table["shard"].to_pylist(), keys):
        own.setdefault(shard, []).append(k)
    counts = np.concatenate([unpack_counts(c) for c in table["counts"].to_pylist()])
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, weights=counts).astype(np.int64)
    mine = {s: k[0] if len(k) == 1 else np.unique(np.concatenate(k)) for s, k in own.items()}
    n = len(mine)
    return pa.table({"n": pa.array([table["n"][0].as_py()] * n, pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()] * n, pa.int32()),
                     "shard": pa.array(list(mine), pa.int64()),
                     "totals": pa.array([pack_counts(total[np.searchsorted(every, k)]) for k in mine.values()], pa.binary())})


def backoff_scores(docs: DataFrame, order: int = ORDER, shard: Column | None = None, text: str = "text", backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, n_found): summed natural logarithms, and words whose longest n-gram occurs elsewhere."""
    if shard is None:
        shard = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // SHARD_ROWS)))
    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), shard.cast("long").alias("shard"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, (size // 6 // BUCKET_GRAMS).bit_length())
    answers = cut_lineage(_sent(texts, order, bits).groupBy("n", "bucket").applyInArrow(
        _answered, "n int, bucket int, shard long, totals binary"), "counts")
    # Every word stands once in each shard's answer for n = 1 weighted by its use there; the corpus size is counted apart.
    words = cut_lineage(_word_counts(texts), "words").agg(F.sum("words")).first()[0] or 0
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "log_score", "n_found"]
        if not rows.num_rows:
            return pa.table([pa.array([], rows.schema.field("doc_id").type), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int64())], names=names)
        data, starts = utf8(rows["text"].combine_chunks())
        counts, hashes, there = grams(data, starts, order)
        doc = np.repeat(np.arange(len(counts)), counts)
        known = known.sort_by([("n", "ascending"), ("bucket", "ascending")])
        others = []
        for n in range(order):  # what other documents hold of the n-gram that ends at each word
            at = np.flatnonzero(there[n])
            keys, where = np.unique(hashes[n][at], return_inverse=True)
            totals = np.concatenate([np.zeros(0, np.int64), *(unpack_counts(t) for t, k in zip(known["totals"].to_pylist(), known["n"].to_pylist()) if k == n + 1)])
            pair = where * len(counts) + doc[at]
            _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
            rest = np.zeros(len(doc), np.int64)
            rest[at] = totals[where] - own[back]
            others.append(rest)
        left = np.maximum(words - counts[doc], 1)
        value = np.log(np.maximum(others[0], 0.5) / left)
        longest = np.minimum(np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts), order - 1)
        found = others[0] > 0
        for n in range(1, order):
            history = np.concatenate([[0], others[n - 1][:-1]]) if len(doc) else others[n - 1]
            hit = there[n] & (others[n] > 0)
            value = np.where(hit, np.log(np.maximum(others[n], 1) / np.maximum(history, 1)), np.where(there[n], np.log(backoff) + value, value))
            found = np.where(longest >= n, hit, found)
        return pa.table([rows["doc_id"].combine_chunks(), pa.array(counts), pa.array(np.bincount(doc, weights=value, minlength=len(counts))),
                         pa.array(np.bincount(doc, weights=found, minlength=len(counts)).astype(np.int64))], names=names)

    scored = texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(
        score, f"doc_id {kind}, n_words long, log_score double, n_found long")
    return scored.select("doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"), "n_found")


def _word_counts(texts: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in chunks(batches, "text"):
            total += int(word_starts(*utf8(batch.column("text")))[2].sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["words"])

    return texts.select("text").mapInArrow(count, "words long")
