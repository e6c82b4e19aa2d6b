"""Mixing sources to target weights.

Each source's words lie on one line, document after document, cut into blocks of fixed length. Output shards hold a fixed
number of slots; how many of a shard's slots go to each source is a multinomial draw, conditioned on the sources' totals
(shards are split in halves again and again, each split a hypergeometric draw), so the mix meets its targets exactly and any
range of shards can be drawn by itself. A slot's number within its source goes through a pseudorandom permutation of the
source's block indexes, and the slots meet the documents in a join on the block index.

A target beyond a source's size is a second pass with another permutation; no word is taken more than twice. Null texts
have size 0, a null source counts as a source of its own and comes last. Documents without words and sources without words
take nothing. Repeated rows are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserix.llm.common import chunks, extended, mix, running, tidy, utf8, word_starts
from tesserix.session import cut_lineage

BLOCK = 64
SLOTS_PER_SHARD = 1024
WEIGHTS = (5, 2, 1)
SHARE = 1.5


@dataclass(frozen=True)
class Part:
    """One source in the mix: its place in order, words, and words to take."""

    number: int
    size: int
    target: int


def sized(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The kept columns and ``size``, the number of words of the whole text. Stored, because it is read several times."""
    kept = docs.select(*keep)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            words = word_starts(*utf8(batch.column("_text")))[2]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(words, pa.int64())],
                                             names=[*keep, "size"])

    return cut_lineage(docs.select(*keep, F.col(text).alias("_text")).mapInArrow(count, extended(kept, "size long")), "sized")


def targets(sized_docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, times: int = 2) -> DataFrame:
    """(source, number, source_size, target): one row per source. The cap on a source is the water level at which the sum of
    all is ``share`` of all words: sources in the order in which they fill up, each filled one leaves the rest to the others."""
    s = sized_docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("number", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    s = s.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(times))
    s = s.withColumn("_full", F.col("_cap") / F.col("_w"))
    fill = Window.orderBy("_full", "number")
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "_all": F.sum("source_size").over(everything) * share,
        "_before": F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_rest"))
    # The level of the first source that doesn't fill up; all filled (share >= times) leaves no such source.
    s = s.withColumn("_level", F.min(F.when(F.col("_full") > F.col("_level"), F.struct("_full", "number", "_level"))).over(everything)["_level"])
    return s.select("source", "number", "source_size",
                    F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.col("_cap")).alias("target"))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1: four Feistel rounds over the next even number of bits, walked until inside."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, 5, dtype=np.uint64) + np.uint64(key % (1 << 62)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _draw(counts: np.ndarray, take: int, seed: list[int]) -> np.ndarray:
    """How many of each kind are among ``take`` drawn without return. Beyond the generator's range (10^9) it rounds a normal draw."""
    rng, out, left = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed))), np.zeros_like(counts), int(counts.sum())
    for i, n in enumerate(counts):
        n, rest = int(n), left - int(n)
        low, high = max(0, take - rest), min(n, take)
        if low == high:
            k = low
        elif left < 10 ** 9:
            k = int(rng.hypergeometric(n, rest, take))
        else:
            mean, var = take * n / left, take * (n / left) * (rest / left) * ((left - take) / (left - 1))
            k = min(high, max(low, round(rng.normal(mean, var ** 0.5))))
        out[i], take, left = k, take - k, rest
    return out


def shard_counts(slots: np.ndarray, first: int, last: int, per_shard: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard from ``first`` to before ``last``: (shard, slots of each source before it, slots of each source in it)."""
    shards = -(-int(slots.sum()) // per_shard)

    def walk(a: int, b: int, before: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if b <= first or a >= last:
            return
        if b - a == 1:
            yield a, before, inside
            return
        middle = (a + b) // 2
        left = _draw(inside, min((middle - a) * per_shard, int(inside.sum())), [seed, a, b])
        yield from walk(a, middle, before, left)
        yield from walk(middle, b, before + left, inside - left)

    if shards:
        yield from walk(0, shards, np.zeros_like(slots), slots)


def _slots_of(p: Part, block: int) -> int:
    """Slots that hold ``p.target`` words: whole passes, and full blocks and one part of a block for the rest."""
    per_pass = -(-p.size // block)
    return (p.target // p.size) * per_pass + -(-(p.target % p.size) // block) if p.size else 0


def draw_slots(spark, parts: list[Part], block: int = BLOCK, per_shard: int = SLOTS_PER_SHARD, seed: int = 20) -> DataFrame:
    """(shard, slot, number, block, words): every slot of the mix and the words it takes from the start of its block."""
    slots = np.array([_slots_of(p, block) for p in parts], np.int64)
    shards = -(-int(slots.sum()) // per_shard)
    group = 64

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g in pdf["id"]:
                for shard, before, inside in shard_counts(slots, int(g) * group, int(g + 1) * group, per_shard, seed):
                    out = []
                    for p, start, n in zip(parts, before, inside):
                        if n:
                            out.append(_place(p, np.arange(start, start + n), block, seed))
                    rows = pd.concat(out, ignore_index=True)
                    order = np.argsort(mix(np.arange(len(rows), dtype=np.uint64) + np.uint64(shard * 2654435761 + seed)), kind="stable")
                    rows = rows.iloc[order]
                    yield rows.assign(shard=shard, slot=np.arange(len(rows)))[["shard", "slot", "number", "block", "words"]]

    groups = -(-shards // group)
    return spark.range(0, groups, 1, max(1, min(groups, 10_000))).mapInPandas(
        fill, "shard long, slot int, number int, block long, words int")


def _place(p: Part, j: np.ndarray, block: int, seed: int) -> pd.DataFrame:
    per_pass, full = -(-p.size // block), p.size // block
    turn, i = j // per_pass, j % per_pass
    at = i.copy()  # the last, shorter block keeps the last place
    words = np.where(i < full, block, p.size - full * block)
    for t in np.unique(turn):
        inner = (turn == t) & (i < full)
        at[inner] = permuted(i[inner], full, (seed * 1000 + int(t)) * 1_000_003 + p.number)
    used = turn * p.size + i * block
    return pd.DataFrame({"number": np.int32(p.number), "block": at, "words": np.minimum(words, p.target - used).astype(np.int32)})


def mix_sources(docs: DataFrame, block: int = BLOCK, per_shard: int = SLOTS_PER_SHARD, seed: int = 20) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every document of ``docs`` (doc_id, text, source).

    Reaches the driver: one row per source (a handful of numbers each), to draw the shards from."""
    base = sized(docs)
    goal = cut_lineage(targets(base), "targets")
    parts = [Part(r.number, r.source_size, round(r.target)) for r in goal.orderBy("number").collect()]
    numbered = base.join(F.broadcast(goal), base["source"].eqNullSafe(goal["source"])).select(
        base["doc_id"], base["source"], base["size"], "number", "source_size", "target",
        F.xxhash64(base["doc_id"]).alias("_mixed"))  # one row per source is broadcast
    lined = cut_lineage(running(numbered, ["_mixed", "doc_id"], "size", "number"), "lined")
    slots = draw_slots(docs.sparkSession, parts, block, per_shard, seed)
    # Stored, as drawn rows have no size estimate of their own and would be broadcast.
    used = cut_lineage(slots.groupBy("number", "block", "words").agg(F.count("*").alias("times")), "used")
    pieces = lined.filter("size > 0").select("row_id", "number", "start", "size", F.explode(F.expr(
        f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    pieces = pieces.select("row_id", "number", "block", F.expr(f"greatest(start - block * {block}, 0)").alias("low"),
                           F.expr(f"least(start + size - block * {block}, {block})").alias("high"))
    taken = pieces.join(used, ["number", "block"]).groupBy("row_id").agg(F.sum(F.expr(
        "greatest(least(words, high) - low, 0) * times")).alias("taken"))
    return lined.join(taken, "row_id", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce(
        "taken", F.lit(0)).cast("long").alias("taken"))


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as whole documents: each row as many times as its words are taken on average, the fraction decided by a hash
    of its id, so a source's expected words are its target. Rows without words stay once. Columns stay as they are."""
    share = mix_sources(docs.select("doc_id", "text", "source")).groupBy(F.col("doc_id").alias("_id")).agg(
        (F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("_share"), F.sum("size").alias("_size"))
    even = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    times = F.when(F.col("_size") == 0, 1).otherwise(F.floor(F.col("_share") + even)).cast("int")
    repeated = docs.join(share, docs["doc_id"].eqNullSafe(share["_id"])).withColumn("_times", times).filter("_times > 0")
    return repeated.withColumn("_turn", F.explode(F.sequence(F.lit(1), "_times"))).select(*docs.columns)
