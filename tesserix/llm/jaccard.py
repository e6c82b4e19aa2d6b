"""Similarity join of texts by the Jaccard measure of their word n-grams, with adaptive multi-match prefixes.

All sets share one order of n-grams: rare ones first, known frequent ones last. If two sets are similar enough, their
prefixes share a token, and prefixes that are l - 1 tokens longer share l of them. Each document chooses the l that it is
estimated to cost least: a longer prefix reads more postings but lets fewer pairs through to verification. A pair becomes a
candidate when its two prefixes share at least the smaller of the two l.

Equal sets are collapsed first. What is wanted is the classes of linked documents, so pairs inside a class that is already
joined need no check. Each posting list is first measured against its most connected member (a star); a set that shares at
least half with such a leader joins its group. Inside a group, sets are compared by what sets them apart from their leader: a pair
that links must share much of that, and copies of one text share little of it. Pairs of different groups meet in posting lists,
the largest group of a list only with the others. Every pair that could still join two classes is checked exactly.

Null and empty texts have no n-grams, link with nothing and are their own component. A text with fewer words than n counts as
one n-gram. Rows of one doc_id are taken as one document, so they are in one component. A null doc_id is never a component's
name; it joins the component of an equal text that has an id, and links nothing by itself. Repeated rows stay in the result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserix.llm.common import chunks, fold_hashes, mix, tidy, utf8, word_hashes, word_starts
from tesserix.llm.components import components
from tesserix.session import cut_lineage, drop_tables, kept_by, recorded_tables

#: Longest extension of a prefix, and what a verification costs in postings read.
MOST_MATCHES = 12
VERIFY_COST = 8
#: Rounds of stars, each over the sets without a group; and tokens that sets of one group must share in prefixes of what they have apart.
#: Neither changes the result.
STARS, MORE_APART = 3, 4
#: A set is measured against a leader with which it shares one prefix token for so many of its n-grams. It does not change the result either.
SHARED_PART = 100
#: At most so many frequent n-grams are known to every task (8 bytes each); the others count as rare. It only sets the order.
FREQUENT = 1 << 17
#: Bits of the filter that leaves most texts of no use out of the second reading; a power of two. What it lets through too much does no harm.
FILTER_BITS = 1 << 24
#: Text bytes whose n-grams are made at once; a worker takes about fifty times as much for it.
SET_BYTES = 1 << 19
_BUFFER, _LOCAL_DF, _FREQUENT_DF = 1 << 21, 3, 24

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LAST = np.uint64(1 << 63)


def gram_sets(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every distinct n-gram, by document, then hash."""
    data = _LOWER[data]
    begin, end, counts = word_starts(data, starts)
    words = word_hashes(data, begin, end)
    doc = np.repeat(np.arange(len(counts)), counts)
    grams, docs = [], []
    if len(words) >= n:
        inside = doc[:len(doc) - n + 1] == doc[n - 1:]
        grams.append(fold_hashes(words, n)[inside])
        docs.append(doc[:len(doc) - n + 1][inside])
    first = np.cumsum(counts) - counts
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        h = np.full(len(short), np.uint64(k), np.uint64)
        for i in range(k):
            h = fold_hashes_step(h, words[first[short] + i])
        grams.append(h)
        docs.append(short)
    h, d = np.concatenate(grams), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[keep], h[keep]


def fold_hashes_step(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(state * np.uint64(0x9E3779B97F4A7C15) + word)


def overlap_needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _frequent(texts: DataFrame, n: int) -> np.ndarray:
    """Hashes of the most frequent n-grams, the least frequent of them first; about, as each task only tells those it met often."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            h = np.concatenate(held)
            held.clear()
            h.sort()
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            k = np.diff(first, append=len(h))
            h, k = h[first[k >= _LOCAL_DF]], k[k >= _LOCAL_DF]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k)], names=["token", "df"])

        for batch in chunks(batches, "text", SET_BYTES):
            held.append(gram_sets(*utf8(batch.column("text")), n)[1])
            if sum(map(len, held)) > _BUFFER:
                yield told()
        if held:
            yield told()

    top = texts.select("text").mapInArrow(count, "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).filter(
        F.col("df") >= _FREQUENT_DF).orderBy(F.desc("df"), "token").limit(FREQUENT)
    rows = top.toPandas()
    return rows["token"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def _sets(texts: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, n, sid, prefix): size and digest of each document's set, and the longest prefix it may use, in order."""
    by_hash = np.argsort(frequent)
    shared = texts.sparkSession.sparkContext.broadcast((frequent[by_hash], by_hash.astype(np.uint64)))

    @tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in chunks(batches, "text", SET_BYTES):
            doc, h = gram_sets(*utf8(batch.column("text")), n)
            size = np.bincount(doc, minlength=batch.num_rows)
            ends = np.cumsum(size)
            key = h & ~_LAST
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                key = np.where(known[at] == h, _LAST | rank[at], key)
            order = np.lexsort((h, key, doc))
            place = np.arange(len(h)) - np.repeat(ends - size, size)
            wanted = np.minimum(size, size - overlap_needed(size, percent) + MOST_MATCHES)
            prefix = h[order][place < np.repeat(wanted, size)].view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(_digests(h, size)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(wanted)]).astype(np.int32)), pa.array(prefix))],
                names=["doc_id", "n", "sid", "prefix"])

    return texts.mapInArrow(digest, f"doc_id {_id(texts)}, n long, sid long, prefix array<long>")


def _digests(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    raw, ends = h.tobytes(), np.cumsum(size).tolist()
    return np.frombuffer(b"".join(hashlib.blake2b(raw[8 * (e - k):8 * e], digest_size=8).digest() for e, k in zip(ends, size.tolist())), "<i8").copy()


def _id(texts: DataFrame) -> str:
    return texts.schema["doc_id"].dataType.simpleString()


def _postings(reps: DataFrame, percent: int) -> DataFrame:
    """(token, doc, n, most, fame): prefix tokens that at least two sets have, cut to the l (``most``) that costs least.

    A set with any partner shares k tokens of its k-th prefix, for every k it may use. Sets with fewer such tokens leave, and with
    them the tokens that only they shared, until the second turn. ``fame`` is the length of all posting lists a set is in."""
    need = F.expr(f"(n * {percent} + 99) div 100")
    tokens = reps.select(F.col("sid").alias("doc"), (F.col("n") - need).alias("_base"), F.posexplode("prefix").alias("_i", "token"))
    # The first prefix that holds the token.
    live = tokens.select("token", "doc", F.greatest(F.lit(1), F.col("_i") - F.col("_base") + 1).cast("int").alias("level"))
    for turn in range(2):
        # Stored, so that the join has an exchange on either side and a frequent token's rows can be split over tasks.
        df = cut_lineage(live.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "df")
        live = cut_lineage(live.join(df, "token"), "postings")
        ks = range(1, MOST_MATCHES + 1)
        sums = live.groupBy("doc").agg(F.sum("df").alias("fame"), *[F.sum(F.when(F.col("level") <= k, F.col("df") - 1)).alias(f"c{k}") for k in ks],
                                       *[F.count(F.when(F.col("level") <= k, 1)).alias(f"m{k}") for k in ks])
        sums = sums.join(reps.select(F.col("sid").alias("doc"), "n"), "doc").withColumn("_need", need)
        # A set cannot ask for more than it must share.
        enough = F.lit(True)
        for k in ks:
            enough = enough & ((F.col("_need") < k) | (F.col(f"m{k}") >= k))
        costs = F.array(*[F.when(F.col("_need") >= k, F.struct((F.col(f"c{k}") * (1 + VERIFY_COST / k)).alias("cost"), F.lit(k).alias("most"))) for k in ks])
        choice = cut_lineage(sums.filter(enough).select("doc", "n", F.array_min(F.array_compact(costs))["most"].alias("most"), "fame"), "choice")
        live = live.drop("df").join(choice, "doc")  # one row per document on the right
        if not turn:
            live = live.select("token", "doc", "level")
    return live.filter("level <= most").select("token", "doc", "n", "most", "fame")


def _candidates(pairs: DataFrame) -> DataFrame:
    """(a, b): pairs, once each, whose prefixes share as many tokens as the more modest of the two asks for."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("a_most", "b_most").alias("most"))
    return ordered.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("most").alias("most")).filter("shared >= most").select("a", "b")


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` of lead and doc with ``linked``, and ``apart``: what only one of the two sets holds, where they share half."""

    @tidy
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            linked, apart = [], []
            for x, y in zip(pdf.pop("x"), pdf.pop("y")):
                a, b = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                only = np.setxor1d(a, b, assume_unique=True)
                union = (len(a) + len(b) + len(only)) // 2
                linked.append(100 * (union - len(only)) >= percent * union)
                apart.append(only if 2 * len(only) <= union else None)
            yield pdf.assign(linked=linked, apart=apart)

    with_y = pairs.join(sets.select("doc", F.col("grams").alias("y")), "doc")  # a set is in one pair
    with_x = with_y.join(_some(sets, pairs.select("lead")).select(F.col("doc").alias("lead"), F.col("grams").alias("x")), "lead")
    return with_x.select("lead", "fame", "doc", "n", "x", "y").mapInPandas(check, "lead long, fame long, doc long, n long, linked boolean, apart array<long>")


def _star(postings: DataFrame, grams: DataFrame, percent: int, done: DataFrame | None) -> DataFrame:
    """Every set measured against the leader it meets in most lists; a list's leader is its most connected member. Pairs measured
    before (``done``) are not measured again."""
    lead = postings.groupBy("token").agg(F.max(F.struct("fame", "doc", "n")).alias("m")).select(
        "token", F.col("m.doc").alias("lead"), F.col("m.fame").alias("fame"), F.col("m.n").alias("lead_n"))
    # Wider than what links: members of one group may link with each other, though not with its leader.
    near = F.expr(f"least(n, lead_n) * 100 >= greatest(n, lead_n) * {2 * percent - 100}")
    pairs = lead.join(postings.select("token", "doc", "n"), "token").filter((F.col("doc") != F.col("lead")) & near)
    met = pairs.groupBy("doc", "lead").agg(F.count("*").alias("shared"), F.first("fame").alias("fame"), F.first("n").alias("n"))
    # One leader a set, so that no more sets are fetched than there are; what it does not tell is left to the later joins.
    # A long set with next to none of its prefix in common is not near; this too is left to them.
    best = met.filter(f"shared * {SHARED_PART} >= n").groupBy("doc").agg(F.max(F.struct("shared", "fame", "lead", "n")).alias("m")).select("m.lead", "m.fame", "doc", "m.n")
    if done is not None:
        best = best.join(done.select("lead", "doc"), ["lead", "doc"], "left_anti").select(best.columns)
    with recorded_tables() as made:
        measured = _measured(cut_lineage(best, "candidates"), grams, percent)
    out = cut_lineage(measured, "stars")
    drop_tables(postings.sparkSession, made)
    return out


def _within_groups(grouped: DataFrame, percent: int) -> DataFrame:
    """(a, b): links inside groups that tell classes apart, from rows doc, group, n, near (linked with the leader), class and apart.

    x and y differ in what only one of their ``apart`` sets holds, so they link if the two share at least
    (excess(x) + excess(y)) / 2(100 + percent), where excess = (100 + percent) |apart| - (100 - percent) n. Most of what a copy has
    apart is its own or rare in the group, which is why prefixes of these sets, rare tokens first, tell copies of one text from each
    other where prefixes of the texts do not. Two sets that are near their leader share its class. Where the excesses sum to 0 or
    less, a pair links in any case; then its smaller side has the class of the group's least, which stands in for it."""
    up, down = 100 + percent, 100 - percent
    rows = grouped.withColumn("size", F.size("apart")).withColumn("excess", F.col("size") * up - F.col("n") * down)
    least = rows.groupBy("group").agg(F.min(F.struct("excess", "doc")).alias("m")).select("group", F.col("m.doc").alias("b"), F.col("m.excess").alias("_e"))
    sure = rows.filter("NOT near").join(least, "group").filter("excess + _e <= 0 AND doc <> b").select(F.col("doc").alias("a"), "b")
    tokens = rows.select("group", "doc", F.explode("apart").alias("token"))
    often = cut_lineage(tokens.groupBy("group", "token").agg(F.count("*").alias("df")).filter("df > 1"), "apart_df")
    # Tokens that no other set of the group has come first: they only shift the others' places.
    known = tokens.join(often, ["group", "token"]).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("_t"))
    placed = rows.drop("apart").join(known, "doc").select("*", F.posexplode("_t").alias("_i", "_s")).select(
        "group", F.col("_s.token").alias("token"), "doc", "size", "excess", "near", "class", (F.col("_i") + F.col("size") - F.size("_t")).alias("place"))
    placed = cut_lineage(placed, "apart")
    x, y = (placed.select("group", "token", *[F.col(c).alias(f"{s}_{c}") for c in ("doc", "size", "excess", "near", "class", "place")]) for s in "xy")
    need = f"(x_excess + y_excess + {2 * up - 1}) div {2 * up}"
    fits = " AND ".join(f"{s}_place < {s}_size - {need} + least({MORE_APART}, {need})" for s in "xy")
    met = x.filter("NOT x_near").join(y, ["group", "token"]).filter(
        f"(y_near OR x_doc < y_doc) AND x_class <> y_class AND x_excess + y_excess > 0 AND {fits}")
    pairs = met.groupBy(F.col("x_doc").alias("a"), F.col("y_doc").alias("b")).agg(F.count("*").alias("shared"), F.first(F.expr(need)).alias("need")).filter(
        f"shared >= least({MORE_APART}, need)")
    pairs = cut_lineage(pairs, "apart_pairs")
    both = pairs.join(rows.select(F.col("doc").alias("a"), F.col("apart").alias("p")), "a").join(rows.select(F.col("doc").alias("b"), F.col("apart").alias("q")), "b")
    return sure.union(both.filter(F.size(F.array_intersect("p", "q")) >= F.col("need")).select("a", "b"))


def _between_groups(marked: DataFrame, percent: int) -> DataFrame:
    """Pairs of different groups and classes in a posting list (token, doc, n, most, group, class): the members outside a list's largest
    group against all, so that a list of one large group and few others costs in proportion."""
    largest = marked.groupBy("token", "group").agg(F.count("*").alias("_k")).groupBy("token").agg(
        F.max(F.struct("_k", "group")).alias("m"), F.count("*").alias("_g")).filter("_g > 1").select("token", F.col("m.group").alias("main"))
    live = cut_lineage(marked.join(largest, "token"), "mixed")
    left, right = (live.select("token", *[F.col(c).alias(f"{s}{e}") for c, e in (
        ("doc", ""), ("n", "_n"), ("most", "_most"), ("class", "_class"), ("group", "_group"))], F.col("main").alias(f"{s}_main")) for s in "ab")
    return left.filter("a_group <> a_main").join(right.drop("b_main"), "token").filter(
        "a_group <> b_group AND a_class <> b_class AND (b_group = a_main OR a < b)"
        f" AND least(a_n, b_n) * 100 >= greatest(a_n, b_n) * {percent}")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""

    @tidy
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"]):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pdf.loc[keep, ["a", "b"]]

    some = _some(sets, pairs.select("a").union(pairs.select("b")))
    with_y = pairs.join(some.select(F.col("doc").alias("b"), F.col("grams").alias("y")), "b")
    with_x = with_y.join(some.select(F.col("doc").alias("a"), F.col("grams").alias("x")), "a")
    return with_x.select("a", "b", "x", "y").mapInPandas(check, pairs.schema)


def _some(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets named by ``wanted`` (one column), stored, so that joins move these only and can split a set that is in many pairs."""
    return cut_lineage(sets.join(wanted.toDF("doc").distinct(), "doc"), "some")


def _filter(wanted: DataFrame) -> np.ndarray:
    """Bits set at the hashes of the wanted documents' ids, in words of 64."""
    at = wanted.select(_bit("doc_id").alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).cast("long")


def _grams(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc, grams): the sets of the documents ``wanted``, and some more, whole, as packed hashes, once each and partitioned by doc.

    Texts that the filter stops are not moved; the others are moved once, as texts, which are smaller than their sets."""
    shared = texts.sparkSession.sparkContext.broadcast(_filter(wanted))

    @tidy
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            at = batch.column("at").to_numpy()
            keep = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            for some in chunks(iter([batch.filter(pa.array(keep == 1))]), "text", SET_BYTES):
                doc, h = gram_sets(*utf8(some.column("text")), n)
                size = np.bincount(doc, minlength=some.num_rows)
                full = pa.array(size > 0)
                yield pa.RecordBatch.from_arrays([pa.array(_digests(h, size)).filter(full), some.column("text").filter(full)], names=["doc", "text"])

    @tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in chunks(batches, "text", SET_BYTES):
            sid = batch.column("doc").to_numpy()
            new = np.append(sid[0] != last, sid[1:] != sid[:-1])  # in order, so equal sets are neighbours
            last, batch = sid[-1], batch.filter(pa.array(new))
            if not batch.num_rows:
                continue
            doc, h = gram_sets(*utf8(batch.column("text")), n)
            size = np.bincount(doc, minlength=batch.num_rows)
            raw, ends = h.tobytes(), np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(
                [raw[8 * int(e - k):8 * int(e)] for e, k in zip(ends, size)], pa.binary())], names=["doc", "grams"])

    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picked = texts.select("text", _bit("doc_id").alias("at")).mapInArrow(pick, "doc long, text string")
    return picked.repartition(buckets, "doc").sortWithinPartitions("doc").mapInArrow(gather, "doc long, grams binary")


def classes(docs: DataFrame, n: int = 4, percent: int = 85, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``: documents link when 100 * intersection >= percent * union."""
    texts = docs.select("doc_id", F.col(text).alias("text"))
    with recorded_tables() as made:
        sets = cut_lineage(_sets(texts, n, percent, _frequent(texts, n)), "sets")
    members = cut_lineage(sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")), "members")
    # Equal sets have equal prefixes, so any copy's will do. Read more than once.
    with recorded_tables() as stored:
        reps = cut_lineage(sets.filter("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")), "reps")
    drop_tables(docs.sparkSession, made)
    with recorded_tables() as made:
        live = _postings(reps, percent)
    postings = cut_lineage(live, "prefixes")
    drop_tables(docs.sparkSession, [*made, *stored])

    first = members.filter("sid IS NOT NULL AND doc_id IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    wanted = cut_lineage(first.join(postings.select(F.col("doc").alias("sid")).distinct(), "sid"), "wanted")
    with kept_by(_grams(texts, wanted, n), "doc", "grams") as grams:
        links = _links(members, postings, grams, percent)
    label = first.join(components(links).withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = label.join(least, "component").select("sid", "component_id")
    return members.join(named, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _links(members: DataFrame, postings: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join all sets of one class."""
    several = members.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("_b")).filter("doc_id IS NOT NULL AND a < _b").drop("_b")
    links = members.filter("sid IS NOT NULL").join(several, "doc_id").select("a", F.col("sid").alias("b"))
    links = cut_lineage(links, "links")
    stars, groups = None, None
    for _ in range(STARS):
        rest = postings if groups is None else postings.join(groups.select("doc"), "doc", "left_anti")
        turn = _star(rest, grams, percent, stars)
        stars = turn if stars is None else stars.union(turn)
        chosen = turn.filter("apart IS NOT NULL").groupBy("doc").agg(F.max(F.struct("fame", "lead", "n", "linked", "apart")).alias("m")).select(
            "doc", F.col("m.lead").alias("group"), F.col("m.n").alias("n"), F.col("m.linked").alias("near"), F.col("m.apart").alias("apart"))
        chosen = cut_lineage(chosen, "chosen")
        if chosen.isEmpty():
            break
        leads = chosen.select(F.col("group").alias("doc"), "group").distinct().join(chosen.select("doc"), "doc", "left_anti")
        new = chosen.unionByName(leads, allowMissingColumns=True)  # a leader met its group already
        groups = new if groups is None else groups.union(new)
    groups = chosen.select("doc", "group", "n", "near", "apart") if groups is None else groups
    links = cut_lineage(links.union(stars.filter("linked").select(F.col("lead").alias("a"), F.col("doc").alias("b"))), "links")
    groups = cut_lineage(groups, "groups")
    known = components(links).withColumnRenamed("node", "doc").withColumnRenamed("component", "class")

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(known, "doc", "left").withColumn("class", F.coalesce("class", "doc"))

    inside = _within_groups(named(groups.filter("apart IS NOT NULL")), percent)
    marked = named(postings.join(groups.select("doc", "group"), "doc", "left")).withColumn("group", F.coalesce("group", "doc"))
    seen = stars.select(F.least("lead", "doc").alias("a"), F.greatest("lead", "doc").alias("b")).distinct()
    todo = cut_lineage(_candidates(_between_groups(marked, percent)).join(seen, ["a", "b"], "left_anti"), "candidates")
    return cut_lineage(links.union(inside).union(_verified(todo, grams, percent)), "links")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class, that of the smallest doc_id; every document without words stays."""
    named = classes(docs, n, percent)
    first = named.filter("n_shingles = 0 OR component_id = doc_id").select("doc_id").distinct()
    kept = docs.filter("doc_id IS NOT NULL").join(first, "doc_id", "left_semi")
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)
