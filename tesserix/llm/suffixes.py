"""Removal of long byte strings that occur more than once, exactly, by suffix arrays over shards of candidate places.

1. Anchors. Every window of the given length has an anchor, the smallest hash among its substrings of 64 bytes, which equal
   windows share. Only anchors that occur twice or more can belong to repeated windows; counting them is one grouping.
2. Contexts. Neighbouring windows of one anchor form a context, a short piece of text. Equal contexts are counted before
   anything is gathered. A context that occurs twice is repeated as a whole.
3. Suffix arrays. The different contexts of an anchor meet in one shard. A shard's suffix array is built by Larsson-Sadakane
   refinement (ranks double their reach, only groups that still tie are sorted again), its common prefixes by Kasai's rule, and
   a window is repeated where a neighbour in the array shares its whole length.
4. Merging. An anchor with more contexts than a shard holds is dealt over several shards. Each gives its sorted list of
   windows; lists that meet in a range of values find each other by binary search, and the shards learn which of theirs
   occur elsewhere too.

Strings are judged on the input; matches never cross texts; overlapping occurrences in one text count. Null and empty texts
lose nothing. Repeated rows are occurrences of their own. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.llm.common import chunks, mix, utf8
from tesserix.session import cut_lineage

LENGTH = 200
GRAM = 64
SHARD_BYTES = 1 << 20
#: Contexts of one anchor that one shard takes.
SHARD_CONTEXTS = 2048
_CHUNK = 2 << 20
_PLACE = np.uint64((1 << 31) - 1)  # texts are shorter than 2^31 bytes
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the 64 bytes from each place on (len - 63 values): eight bytes as a number, then pairs of neighbours, doubled."""
    h = data.astype(np.uint64)
    for width in (1, 2, 4):
        h = h[:-width] | (h[width:] << np.uint64(8 * width))
    h = mix(h + np.uint64(seed + 1))
    for width in (8, 16, 32):
        h = mix(h[:-width] * _STEP + h[width:])
    return h


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value, anchor, first, last): runs of windows of one anchor, their begins relative to their value's."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    hashes = gram_hashes(data)
    low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)  # ties go to the first place
    span, wide = 1, length - GRAM + 1
    while 2 * span <= wide:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    low = np.minimum(low[:len(low) - (wide - span)], low[wide - span:])
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    begin = np.flatnonzero(doc[:len(data) - length + 1] == doc[length - 1:])
    if not len(begin):
        return none, none, none, none
    at = (low[begin] & _PLACE).astype(np.int64)
    new = np.ones(len(begin), bool)
    new[1:] = (at[1:] != at[:-1]) | (begin[1:] != begin[:-1] + 1) | (doc[begin[1:]] != doc[begin[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(begin) - 1]])
    of = doc[begin[first]]
    return of, hashes[at[first]].view(np.int64), begin[first] - starts[of], begin[last] - starts[of]


def suffix_array(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes of several strings; each string's end is smaller than any byte, and than later ends."""
    n, count = len(data), len(starts) - 1
    ends = np.repeat(starts[1:], np.diff(starts))
    left = ends - np.arange(n)
    wide = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | np.where(left > k, wide[k:n + k], np.uint64(0))
    order = np.argsort(key, kind="stable")
    reach = 7
    head = np.ones(n, bool)
    sorted_key = key[order]
    head[1:] = (sorted_key[1:] != sorted_key[:-1]) | (left[order][1:] < reach)
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
    owner = np.repeat(np.arange(count), np.diff(starts))
    alone = head & np.append(head[1:], True)
    slots = np.flatnonzero(~alone)
    while len(slots):
        at = order[slots]
        ended = left[at] == reach  # the end follows: earlier strings first
        then = np.where(ended, owner[at], rank[np.minimum(at + reach, n - 1)] + count)
        both = rank[at] * (n + count + 1) + then
        again = np.argsort(both)
        at, both = at[again], both[again]
        order[slots] = at
        head = np.ones(len(slots), bool)
        head[1:] = both[1:] != both[:-1]
        rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
        slots = slots[~(head & np.append(head[1:], True))]
        reach *= 2
    return order, rank


def common_prefixes(data: np.ndarray, starts: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` with the one before it.

    By Kasai's rule a suffix shares one byte less with its predecessor than the suffix one byte longer does with its own, if
    the same byte comes before both; only the others are compared byte by byte, all of them at once.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    is_start = np.zeros(n, bool)
    is_start[starts[:-1][np.diff(starts) > 0]] = True
    place = np.arange(n)
    follows = (before > 0) & ~is_start & ~is_start[before]
    follows[1:] &= data[place[1:] - 1] == data[before[1:] - 1]
    follows[0] = False
    ends = np.repeat(starts[1:], np.diff(starts))
    todo = np.flatnonzero(~follows & (before >= 0))
    most = np.minimum(ends[todo] - todo, ends[before[todo]] - before[todo])
    shared = np.zeros(n, np.int64)
    a, b, size, which = todo, before[todo], 0, np.arange(len(todo))
    while len(which):
        same = most[which] > size
        same[same] = data[a[which[same]] + size] == data[b[which[same]] + size]
        shared[todo[which[~same]]] = size
        which, size = which[same], size + 1
    origin = np.maximum.accumulate(np.where(follows, 0, place))
    shared = np.where(follows, shared[origin] - (place - origin), shared)
    return shared[order]


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the window that begins at each place lies in its string and occurs at another place too."""
    order, rank = suffix_array(data, starts)
    shared = np.append(common_prefixes(data, starts, order, rank), 0)
    ends = np.repeat(starts[1:], np.diff(starts))
    return (np.maximum(shared[rank], shared[rank + 1]) >= length) & (ends - np.arange(len(data)) >= length)


def window_values(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(place, 16-byte value) of every window."""
    ends = np.repeat(starts[1:], np.diff(starts))
    place = np.flatnonzero(ends - np.arange(len(data)) >= length)
    values = np.empty((len(place), 2), ">u8")
    for seed in (0, 1):
        h, out = gram_hashes(data, seed), np.full(len(place), np.uint64(length), np.uint64)
        for at in [*range(0, length - GRAM, GRAM), length - GRAM]:
            out = mix(out * _STEP + h[place + at])
        values[:, seed] = out
    return place, values.reshape(-1).view("S16")


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def _by_text(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", _CHUNK):
            of, anchor, first, last = anchors(*utf8(batch.column("text")), length)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), batch.column("uid").take(pa.array(of)), pa.array(first.astype(np.int32)),
                                              pa.array(last.astype(np.int32))], names=["anchor", "uid", "first", "last"])

    return texts.select("uid", "text").mapInArrow(find, "anchor long, uid long, first int, last int")


def _contexts(suspects: DataFrame, length: int, with_bytes: bool) -> DataFrame:
    """(anchor, hi, lo, uid, first[, context]) of each suspected run of windows."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", _CHUNK):
            data, starts = utf8(batch.column("text"))
            raw = data.tobytes()
            runs = batch.column("runs")
            of = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            first, last, anchor = (flat.field(k) for k in range(3))
            begin = (starts[of] + first.to_numpy()).tolist()
            end = (starts[of] + last.to_numpy() + length).tolist()
            pieces = [raw[a:b] for a, b in zip(begin, end)]
            digest = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in pieces), "<i8").reshape(-1, 2)
            columns = [anchor, pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), batch.column("uid").take(pa.array(of)), first]
            names = ["anchor", "hi", "lo", "uid", "first"]
            if with_bytes:
                columns.append(pa.array(pieces, pa.binary()))
                names.append("context")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return suspects.select("uid", "text", "runs").mapInArrow(
        cut, "anchor long, hi long, lo long, uid long, first int" + (", context binary" if with_bytes else ""))


_MARK = "hi long, lo long, anchor long, low int, high int"


def _marks(shards: DataFrame, length: int) -> DataFrame:
    """Repeated windows of each context as ranges of begins, found by one suffix array per shard."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(rows: pa.Table) -> pa.RecordBatch:
            data, starts = utf8(rows["context"].combine_chunks())
            flags, out = repeated_windows(data, starts, length), []
            for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                if flags[a:b].any():
                    out += [(k, low, high) for low, high in _runs(flags[a:b])]
            at = pa.array([o[0] for o in out], pa.int64())
            return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks().take(at) for c in ("hi", "lo", "anchor")), pa.array([o[1] for o in out], pa.int32()),
                                               pa.array([o[2] for o in out], pa.int32())], names=["hi", "lo", "anchor", "low", "high"])

        held_bytes = 0
        for batch in chunks(batches, "context", SHARD_BYTES):
            held.append(batch)
            held_bytes += batch.column("context").nbytes
            if held_bytes >= SHARD_BYTES:  # the last anchor's contexts wait for the rest of them
                rows = pa.Table.from_batches(held)
                key = np.stack([rows["anchor"].to_numpy(), rows["part"].to_numpy()], axis=1)
                same = (key == key[-1]).all(axis=1)
                cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield finish(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
                    held_bytes = sum(b.column("context").nbytes for b in held)
        if held and sum(b.num_rows for b in held):
            yield finish(pa.Table.from_batches(held))

    return shards.select("anchor", "part", "hi", "lo", "context").repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(
        scan, _MARK)


def _merged_marks(shards: DataFrame, length: int) -> DataFrame:
    """Windows that shards of one anchor have in common."""
    buckets = max(1, shards.count() // 4096)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "context", SHARD_BYTES):
            data, starts = utf8(batch.column("context"))
            place, value = window_values(data, starts, length)
            row = np.searchsorted(starts, place, side="right") - 1
            bucket = value.view(">u8")[::2].astype(np.uint64) % np.uint64(buckets)
            shard = (mix(batch.column("anchor").to_numpy().view(np.uint64)) + batch.column("part").to_numpy().astype(np.uint64))[row]
            order = np.lexsort((value, shard, bucket))
            bucket, shard, value = bucket[order], shard[order], value[order]
            new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (shard[1:] != shard[:-1])])) if len(bucket) else np.zeros(0, int)
            ends = np.append(new[1:], len(bucket))
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[new].astype(np.int32)), pa.array(shard[new].view(np.int64)),
                pa.array([np.unique(value[a:b]).tobytes() for a, b in zip(new, ends)], pa.binary())], names=["bucket", "shard", "windows"])

    def meet(table: pa.Table) -> pa.Table:
        own: dict[int, list[np.ndarray]] = {}
        for s, w in zip(table["shard"].to_pylist(), table["windows"].to_pylist()):
            own.setdefault(s, []).append(np.frombuffer(w, "S16"))
        own_sorted = {s: np.unique(np.concatenate(w)) for s, w in own.items()}  # one list per shard, whatever tasks it was read by
        everything = np.sort(np.concatenate(list(own_sorted.values())))
        out = []
        for s, w in own_sorted.items():
            times = np.searchsorted(everything, w, side="right") - np.searchsorted(everything, w, side="left")
            if (times > 1).any():
                out.append((s, w[times > 1].tobytes()))
        return pa.table({"shard": pa.array([o[0] for o in out], pa.int64()), "windows": pa.array([o[1] for o in out], pa.binary())})

    def mark(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and known.num_rows:
            data, starts = utf8(rows["context"].combine_chunks())
            place, value = window_values(data, starts, length)
            wanted = np.sort(np.frombuffer(b"".join(known["windows"].to_pylist()), "S16"))
            at = np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)
            flags = np.zeros(len(data), bool)
            flags[place[wanted[at] == value]] = True
            for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                out += [(k, low, high) for low, high in _runs(flags[a:b])]
        at = pa.array([o[0] for o in out], pa.int64())
        return pa.table([*(rows[c].combine_chunks().take(at) for c in ("hi", "lo", "anchor")), pa.array([o[1] for o in out], pa.int32()),
                         pa.array([o[2] for o in out], pa.int32())], names=["hi", "lo", "anchor", "low", "high"])

    found = shards.select("anchor", "part", "context").mapInArrow(lists, "bucket int, shard long, windows binary").groupBy(
        "bucket").applyInArrow(meet, "shard long, windows binary")
    numbered = shards.select("anchor", "hi", "lo", "context", "part").mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([*(b.column(c) for c in ("anchor", "hi", "lo", "context")), pa.array(
            (mix(b.column("anchor").to_numpy().view(np.uint64)) + b.column("part").to_numpy().astype(np.uint64)).view(np.int64))],
            names=["anchor", "hi", "lo", "context", "shard"]) for b in batches), "anchor long, hi long, lo long, context binary, shard long")
    return numbered.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(mark, _MARK)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, text: str = "text", shard_contexts: int = SHARD_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(texts that may hold repeats: uid, text; ranges: uid, low, high of begins of repeated windows)."""
    texts = _by_text(docs, text)
    found = cut_lineage(_anchor_rows(texts, length), "anchors")
    # Stored, so that the join has an exchange on either side and a frequent anchor's rows can be split over tasks.
    several = cut_lineage(found.groupBy("anchor").agg(F.count("*").alias("_n")).filter("_n > 1").select("anchor"), "several")
    runs = found.join(several, "anchor").groupBy("uid").agg(F.collect_list(F.struct("first", "last", "anchor")).alias("runs"))
    suspects = cut_lineage(texts.select("uid", "text").join(runs, "uid"), "suspects")
    contexts = cut_lineage(_contexts(suspects, length, True).groupBy("anchor", "hi", "lo").agg(
        F.count("*").alias("times"), F.first("context").alias("context")), "contexts")
    sizes = cut_lineage(contexts.groupBy("anchor").agg(F.count("*").alias("_size")).filter("_size > 1"), "sizes")
    parted = contexts.join(sizes, "anchor").withColumn("part", F.expr(f"cast(pmod(hi, (_size + {shard_contexts - 1}) div {shard_contexts}) as int)"))
    whole = contexts.filter("times > 1").select("hi", "lo", "anchor", F.lit(0).alias("low"), (F.length("context") - length).alias("high"))
    marks = whole.union(_marks(parted, length))
    split = cut_lineage(parted.filter(f"_size > {shard_contexts}"), "split")
    if not split.isEmpty():
        marks = marks.union(_merged_marks(split, length))
    places = _contexts(suspects, length, False).join(cut_lineage(marks.distinct(), "marks"), ["anchor", "hi", "lo"])
    return suspects, places.select("uid", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))


def without_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """(uid, n_removed, n_spans, kept) of the texts that lose something; ``kept`` are the bytes left."""
    suspects, ranges = repeated_ranges(docs, length, text, shard_contexts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", _CHUNK):
            data, starts = utf8(batch.column("text"))
            lists = batch.column("ranges")
            offsets, flat = lists.offsets.to_numpy(), lists.flatten()
            offsets = offsets - offsets[0]
            low, high = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            rows = []
            for k in range(batch.num_rows):
                body = data[starts[k]:starts[k + 1]]
                step = np.zeros(len(body) + 1, np.int64)
                np.add.at(step, low[offsets[k]:offsets[k + 1]], 1)
                np.add.at(step, high[offsets[k]:offsets[k + 1]] + length, -1)
                gone = np.cumsum(step)[:-1] > 0
                rows.append((int(gone.sum()), len(_runs(gone)), body[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.binary())))], names=["uid", "n_removed", "n_spans", "kept"])

    lists = ranges.groupBy("uid").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    return suspects.dropDuplicates(["uid"]).join(lists, "uid").select("uid", "text", "ranges").mapInArrow(
        cut, "uid long, n_removed long, n_spans long, kept binary")


def repeats_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    cut = without_repeats(docs, length).select("uid", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    every = _by_text(docs, "text").select("doc_id", "uid", F.octet_length("text").cast("long").alias("n_bytes"),
                                          F.sha2(F.encode("text", "UTF-8"), 256).alias("whole"))
    return every.join(cut, "uid", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
