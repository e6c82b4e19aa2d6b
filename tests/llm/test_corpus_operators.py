"""Every operator against a brute-force version, on rough and on empty tables."""

import hashlib
import heapq
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tesserix.llm import common
from tesserix.llm import backoff, jaccard, media, mixing, neighbours, packing, secrets, sharding, suffixes, toxicity
from tesserix.llm.components import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return SPACE.findall((text or "").translate(LOWER))


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if r.doc_id is not None)


# 1 toxicity

def test_fold_and_exceptions():
    assert toxicity.fold("  M0R0N, Idiöt! stуpid ") == " moron idiot stypid "
    assert toxicity.fold("stupid$$$ 1d10t 2024 a1") == " stupid idiot 2024 a1 "
    assert toxicity.fold(None) == "  "
    lexicon = toxicity.Lexicon({" trash ": 2.0, " idi": 1.0, " idiot ": 3.0})
    found = lexicon.automaton()
    assert toxicity.hits(found, toxicity.fold("trash idiot idiotic")) == (6.0, 3)
    assert toxicity.hits(found, toxicity.fold("the trash can, useful idiot")) == (0, 0)


def test_substitutes_at_word_ends_and_ones():
    lexicon = toxicity.Lexicon({toxicity.fold(w): 2.0 for w in (*toxicity.SEED, "ass")} | {" scu": 1.0})
    found, known = lexicon.automaton(), lexicon.known()

    def hit(text):
        return toxicity.hits(found, toxicity.fold(text, known))[1]

    for text in ("whor3", "imbecil3", "idio7", "a$$", "c1own", "1oser", "wh0r3!", "assh01e", "sc7 scu", "an idiot, a1", "stupid$$$", "5cum5", "IDI0T", "gi1ipo11a5"):
        assert hit(text) == 1, text
    assert hit("idio7 c1own a$$ stupid$$ and whor3") == 5
    for text in ("a1 b2 c5 10 2024", "clown fish, c1own f1sh", "useful idio7", "sore 1oser", "mp3 $5 h1"):
        assert hit(text) == 0, text
    assert toxicity.hits(toxicity.Lexicon({" loser ": 2.0}).automaton(), toxicity.fold("1oser")) == (2.0, 1)
    assert {" idiot ", " idio7 "} <= toxicity._terms("idio7")


def test_toxicity_learns_and_ignores_held_out(spark, empty):
    texts = [(i, ("zabul " if i % 5 == 0 else "") + f"word{i % 7} plain text {'zabul' if i % 5 == 0 else ''}", "en", "s") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    # Labels of the held-out fifth are wrong on purpose: they must not matter.
    labels = spark.createDataFrame([(i, 1, int((i % 5 == 0) != (i in held))) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_digest(docs, labels).collect()}
    assert all(got[i].predicted == (i % 5 == 0) and got[i].held_out == (i in held) for i in range(400))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()} == {i for i in range(400) if i % 5}
    assert toxicity.toxicity_digest(empty, labels).count() == 0


def test_a_language_more_often_toxic_is_no_lexicon(spark):
    """Two languages, one of them three times as often toxic; only abuse counts, and scores are those of a plain count of it."""
    rng = np.random.default_rng(2)
    tongues = [[f"{stem}{i}" for i in range(300)] for stem in ("lingua", "sprache")]
    abuse, texts, labels = ["zork", "blarg", "fnord"], [], []
    for i in range(3000):
        second = i % 3 == 0
        toxic = rng.random() < (0.3 if second else 0.1)
        some = rng.choice(tongues[second], 60).tolist() + (rng.choice(abuse, 4).tolist() if toxic else [])
        texts.append((i, " ".join(rng.permutation(some).tolist())))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, marks)
    learned = set(lexicon.terms) - {toxicity.fold(w) for w in toxicity.SEED}
    assert learned and all(any(toxicity.fold(w).startswith(t) for w in abuse) for t in learned)
    a, b, c = lexicon.curve
    truth, texts = dict(labels), dict(texts)
    for r in toxicity.toxicity_digest(docs, marks).collect():
        weight = sum(max(w for t, w in lexicon.terms.items() if toxicity.fold(word).startswith(t)) for word in texts[r.doc_id].split() if word in abuse)
        n = len(texts[r.doc_id].split()) if r.doc_id < 40 else 60 + 4 * truth[r.doc_id]
        assert r.score == pytest.approx(1 / (1 + math.exp(-(a + b * math.log1p(weight) + c * math.log1p(100 * weight / n)))))
        assert r.predicted == truth[r.doc_id]


def test_toxicity_rough(rough, empty):
    got = toxicity.toxicity_digest(rough, rough.limit(0).selectExpr("doc_id", "1 AS toxic"))
    assert got.count() == rough.count() and got.filter("predicted = 1 OR score IS NULL").count() == 0
    assert toxicity.without_toxic(rough, rough.selectExpr("doc_id", "0 AS toxic")).columns == rough.columns


# 2 mixing

def filled(sizes, weights, total):
    """Water level by repeated sharing of the excess."""
    target, free, left = {}, set(sizes), total
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def test_mix(rough, empty):
    got = mixing.mix_sources(rough).collect()
    want = Counter((r.doc_id, r.source, len(words(r.text))) for r in rough.collect())
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == want
    sizes = Counter()
    for (_, s, n), k in want.items():
        sizes[s] += n * k
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(rough).collect()))
    assert mixing.mix_digest(empty).count() == 0
    assert mixing.mixed_documents(rough).columns == rough.columns


def test_permutation_and_shards():
    for n in (1, 2, 3, 17, 100, 1025):
        assert sorted(mixing.permuted(np.arange(n), n, 9)) == list(range(n))
    slots = np.array([1000, 10, 0, 333])
    whole = list(mixing.shard_counts(slots, 0, 99, 50, 3))
    assert sum(w[2] for w in whole).tolist() == slots.tolist() and all(w[2].sum() == 50 for w in whole[:-1])
    some = list(mixing.shard_counts(slots, 5, 8, 50, 3))
    assert [(a, b.tolist(), c.tolist()) for a, b, c in some] == [(a, b.tolist(), c.tolist()) for a, b, c in whole[5:8]]
    for a, b in itertools.pairwise(whole):
        assert (a[1] + a[2] == b[1]).all()


# 3 neighbours

def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(300)] + [(300 + i, [0.5] * 8, 0) for i in range(60)]
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (403, [1.0, None], 0), (404, [float("inf")] * 8, 0), (405, [], 0),
             (406, [2.0, 1.0], 0), (420, [1.0, 2.0], 0), (300, [0.5] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    good = {i: v for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    assert set(got) == {i for i in good if i % 20 == 0}
    for q, found in got.items():
        want = heapq.nsmallest(20, [(-float(np.dot(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q])], key=lambda t: (round(t[0], 12), t[1]))
        assert [i for i, _ in found] == [i for _, i in want] and [s for _, s in found] == pytest.approx([-s for s, _ in want])
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


# 4 backoff

@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(rough, empty, order):
    texts = [words(r.text) for r in rough.collect()]
    count = [Counter(tuple(w[i:i + n]) for w in texts for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(map(len, texts))

    def brute(w):
        own = [Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)]

        def others(g):
            return count[len(g) - 1][g] - own[len(g) - 1][g]

        def s(g):
            if len(g) == 1:
                return math.log(max(others(g), 0.5) / max(total - len(w), 1))
            return math.log(others(g) / others(g[:-1])) if others(g) else math.log(0.4) + s(g[1:])

        return sum(s(tuple(w[max(0, i - order + 1):i + 1])) for i in range(len(w)))

    got = backoff.backoff_scores(rough, order).collect()
    want = sorted((len(w), brute(w)) for w in texts)
    found = sorted((r.n_words, r.log_score) for r in got)
    assert [n for n, _ in found] == [n for n, _ in want] and [s for _, s in found] == pytest.approx([s for _, s in want])
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
    assert backoff.backoff_scores(empty, order).count() == 0


def test_packed_keys():
    for keys in ([], [5], [0, 1, 2 ** 64 - 1], [7, 7 + 2 ** 17, 2 ** 60]):
        assert backoff.unpack_sorted(backoff.pack_sorted(np.array(keys, np.uint64))).tolist() == keys
    for counts in ([], [1, 1, 2], [1, 256], [70_000], [1, 2 ** 40]):
        assert backoff.unpack_counts(backoff.pack_counts(np.array(counts, np.int64))).tolist() == counts


# 5 sharding

def test_hilbert_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2), (2, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        at = sharding.hilbert_index(cells, bits)
        assert sorted(at) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_shards(rough, empty, tmp_path):
    got = sharding.shard_digest(rough).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rough.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(slots[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_digest(empty).count() == 0
    few = sharding.shard_digest(rough.limit(3)).collect()
    assert len({r.shard for r in few}) == 3 and all(r.slot == 0 for r in few)
    ranges = sharding.write_shards(rough.select("doc_id", "lang", "source", "n_chars"), str(tmp_path / "s"), ["n_chars", "source"], 4).collect()
    assert sum(r["rows"] for r in ranges) == len(got)


def test_strings_that_share_their_beginning(spark):
    for n in (20, 700):  # a cell for each value, and cells by shares of the rows
        names = [f"https://host/{i:04}" for i in range(n)]
        rows = [(s,) for s in names for _ in range(3)] + [(None,)]
        got = {r.source: r.curve for r in sharding.with_curve(spark.createDataFrame(rows, "source string"), ["source"]).collect()}
        cells = [got[s] for s in names]
        assert got[None] == 0 and cells == sorted(cells) and cells[0] > 0 and len(set(cells)) >= min(n, 250)
        assert max(Counter(cells).values()) <= -(-n // 250)


# 6 Jaccard join

def brute_classes(pairs, n, percent):
    sets = defaultdict(list)
    for i, t in pairs:
        w = words(t)
        sets[i].append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for (i, x), (j, y) in itertools.combinations([(i, s) for i, all_ in sets.items() for s in all_ if s], 2):
        if i != j and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 60)])
def test_classes(rough, empty, n, percent):
    got = jaccard.classes(rough, n, percent).collect()
    want = brute_classes(rows_of(rough), n, percent)
    assert len(got) == rough.count()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert jaccard.classes(empty, n, percent).count() == 0
    kept = jaccard.one_of_each(rough, n, percent)
    assert {r.doc_id for r in kept.collect()} - {None} == {i for i, c in want.items() if i == c} and kept.columns == rough.columns


@pytest.mark.parametrize("seed,n,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_classes_of_edited_copies(spark, seed, n, percent):
    """Copies with a few words replaced, cut or added: some link with their text, some only with each other, most not."""
    rng = random.Random(seed)
    rows = []
    for base in range(3):
        text = [f"b{base}w{i}" for i in range(rng.choice([60, 150]))]
        last = text
        for _ in range(60):
            words = list(last if rng.random() < 0.4 else text)
            for _ in range(rng.randint(0, 7)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
            if rng.random() < 0.3:
                words = words[rng.randint(0, 12):]
            if rng.random() < 0.3:
                words += [f"y{rng.randrange(10 ** 6)}" for _ in range(rng.randint(1, 25))]
            rows.append((len(rows), " ".join(words)))
            last = words
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
    want = brute_classes(rows, n, percent)
    assert got == want
    assert 3 < len(set(want.values())) < len(rows) - 20


def test_classes_with_common_passages_and_chains(spark):
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"w{rng.integers(1e6)}" for _ in range(rng.integers(1, 60)))) for i in range(150)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(40):  # each step changes one place; the ends have little in common
        rows.append((1000 + i, " ".join(chain)))
        chain[(i * 7) % 100] = f"x{i}"
    centre = [f"s{i}" for i in range(100)]
    for i in range(80):  # similar to the centre, hardly to each other
        w = list(centre)
        for k in range(2):
            w[(i * 11 + 37 * k) % 100] = f"y{i}_{k}"
        rows.append((2000 + i, " ".join(w)))
    rows.append((3000, " ".join(centre)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()}
    assert got == brute_classes(rows, 4, 85)


def test_only_texts_in_question_are_moved(spark, monkeypatch):
    """Few of the texts have a partner, so few are shuffled; and each set is fetched once, whatever the copies of its text."""
    from tesserix import session

    rng, moved = random.Random(4), []
    prose = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(80)) for _ in range(1000)]
    rows = [(i, t) for i, t in enumerate(prose)] + [(2000 + i, prose[i] + " more") for i in range(20)] + [(3000 + i, prose[i]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = session.kept_by

    def watched(df, key, name):
        moved.append(df.count())
        return kept(df, key, name)

    monkeypatch.setattr(jaccard, "kept_by", watched)
    before = {t.name for t in spark.catalog.listTables()}
    got = {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()}
    assert got == {i: i - 2000 if 2000 <= i < 3000 else i - 3000 if i >= 3000 else i for i, _ in rows}
    assert moved == [40]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_sets_of_many_texts_are_made_in_little_memory(monkeypatch):
    rng = random.Random(8)
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(str(rng.randrange(10 ** 6)) for _ in range(10000)) for _ in range(60)]})
    monkeypatch.setattr(common, "_POWERS", {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)})
    tracemalloc.start()
    try:
        some = list(common.chunks(iter([batch]), "text", jaccard.SET_BYTES))
        assert sum(b.num_rows for b in some) == 60 and len(some) > 5
        for b in some:
            jaccard.gram_sets(*common.utf8(b.column("text")), 5)
        assert tracemalloc.get_traced_memory()[1] < 32 << 20  # 70 MiB in pieces of CHUNK_BYTES
    finally:
        tracemalloc.stop()


def test_a_step_gives_memory_back_at_its_end(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    step = common.tidy(lambda batches: (2 * b for b in batches))
    assert list(step(iter([1, 2]))) == [2, 4] and given == [1]
    ended = step(iter([1, 2]))
    assert next(ended) == 2 and given == [1]
    ended.close()
    assert given == [1, 1]
    monkeypatch.undo()
    for _ in range(2):
        held = pa.array(np.arange(1 << 20))
        del held
        common.give_back()


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(300 + i, 301 + i) for i in range(40)] + [(500, i) for i in range(400, 450)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}
    for a, b in links:
        if a != b:
            up.setdefault(a, {a}), up.setdefault(b, {b})
            both = up[a] | up[b]
            for x in both:
                up[x] = both
    assert got == {a: min(s) for a, s in up.items()}


# 7 media

def test_audio(rough, empty):
    want = Counter()
    for r in rough.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    got = media.audio_digest(rough).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert media.audio_digest(empty).count() == 0


def test_sound():
    for n in (1, 3, 576):
        x = np.sin(np.arange(n) * 0.3)
        y, h = media.resampled(x), media._phases()
        for m, v in enumerate(y):
            a = m * media.DOWN
            assert v == pytest.approx(sum(h[a % media.UP][k] * x[a // media.UP - k] for k in range(media.TAPS) if 0 <= a // media.UP - k < n))
    low, high = (np.argmax(media.log_mel(media.resampled(np.sin(2 * np.pi * f * np.arange(8000) / 8000)))[0].mean(axis=0)) for f in (200, 2000))
    assert low < high
    loud = np.concatenate([np.zeros(4000), np.ones(4000), np.zeros(4000)]) * np.sin(np.arange(12000))
    spans = media.active_spans(media.log_mel(loud)[1])
    assert len(spans) == 1 and abs(spans[0][0] * media.HOP - 4000) <= 256 and abs(spans[0][1] * media.HOP - 8000) <= 256
    tensors, seconds = media.from_tensor_column(media.tensor_column(*media.features(media.padded(b"hello " * 900))[2:]))
    assert tensors.shape[1:] == (media.TENSOR_FRAMES, media.MELS) and (seconds[:, 0] < seconds[:, 1]).all()


# 8 packing

def test_a_sentence_of_a_million_words_takes_linear_time():
    """Twice the words take about twice the time, and the cuts are those of short texts."""
    import time

    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.learn({b"word", b"other"})
    spent = []
    for n in (250_000, 1_000_000):
        words = [b"word", b"other"] * (n // 2)
        began = time.process_time()
        cuts, crcs, kinds = encoder.places(words, 2)
        spent.append(time.process_time() - began)
        assert cuts[-1] == n + 1 and set(np.diff(cuts[:-1])) == {packing.FORCED_STEP} and set(kinds[:-1]) == {0}
        ids = b"".join(encoder.known[w] for w in words)
        assert crcs[5] == zlib.crc32(ids[:4 * cuts[5]]) and crcs[-1] == zlib.crc32(ids + (2).to_bytes(4, "little"))
    assert spent[1] < 10 * spent[0] + 0.5


def test_best_cuts_are_cheapest():
    rng = np.random.default_rng(4)
    for _ in range(30):
        step = rng.integers(1, 9, rng.integers(1, 9))
        position, price = np.cumsum(step), rng.integers(0, 6, len(step))

        def cost(cuts):
            at = [0, *position[list(cuts)]]
            return sum(12 - (b - a) + price[j] for a, b, j in zip(at, at[1:], cuts)) if all(b - a <= 12 for a, b in zip(at, at[1:])) else math.inf

        last = len(step) - 1
        best = min(cost((*c, last)) for k in range(last + 1) for c in itertools.combinations(range(last), k))
        assert cost(packing.best_cuts(position, price, 12)) == best


def test_packing(rough, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = Tokenizer.from_file(path)
    odd = rough.sparkSession.createDataFrame([(90, "a<|endoftext|>b <|endoftext|> x y é ΣΣ \x1c don't", "en", "a")], "doc_id long, text string, lang string, source string")
    docs = rough.select("doc_id", "text").union(odd.select("doc_id", "text")).filter("doc_id <> 1")
    got = packing.pack(docs, path).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text in rows_of(docs):
        ids, at = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.pack(empty, path).count() == 0
    assert packing.pack(rough, path).groupBy("doc_id").count().count() == rough.select("doc_id").distinct().count()


def test_ids_of_a_batch_are_those_of_the_whole_texts():
    """Signs behind words, capitals, marks that join a small letter only, special tokens and texts at the sizes where forced places begin."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tesserix.llm.common import utf8

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["", None, " ", "Hello, World. end", "x. y! z?", ". . .", "\u00a0 . a", "\u00c9. \u00e9, \u00d7. \u00f7, \u00d6!", "5. a1. 3,", "\u0130. \u03a3\u03b1\u03c2 \u039f\u0394\u039f\u03a3.",
             "don't. DON'T!! it's", "a" * 50 + "." * 20, "H\u0331. T\u0308 J\u030c, H\u0323\u0331", "\u4e2d\u6587\u3002 x\u3002.", "\u212a\u212a. \u1e9e.", "w " * 64, "w " * 65, "w " * 97 + "."]
    tokenizer = Tokenizer.from_file(path)
    for some in (texts, [*texts, "<|endoftext|> A<|ENDOFTEXT|>. <|x|>. Word"]):
        encoder = packing.WordEncoder(path)
        encoder.known.clear()
        many, cuts, crcs, kinds = encoder.all_places(*utf8(pa.array(some)), 2)
        last = np.cumsum(many) - 1
        want = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in some]
        assert [len(w) for w in want] == cuts[last].tolist() and [zlib.crc32(w.tobytes()) for w in want] == crcs[last].tolist()
        assert (kinds[last] == 2).all() and (kinds == 2).sum() == len(some)
    encoder.known.clear()
    encoder.all_places(*utf8(pa.array(["Word, WORD. word! (word)"])), 2)
    assert {b"word", b",", b".", b"!"} <= set(encoder.known) and not {b"Word", b"Word,", b"WORD.", b"word!"} & set(encoder.known)


def test_packing_of_letters_that_become_letter_and_mark(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["İstanbul plain İ. dİ! क़लम क़. word", "İİ", "x İSTANBUL, é. ﬁ"]
    got = {r.doc_id: r for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].doc_tokens, got[i].length, got[i].ids_crc32) == (len(ids), len(ids), zlib.crc32(ids.tobytes()))


# 9 secrets

KINDS = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
         ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]


def base_spans(text):
    spans = [(m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return [(s, e, name) for s, _, e, name in sorted(spans)]


def test_secrets(rough, empty):
    rows = rough.filter("doc_id IS NOT NULL AND doc_id <> 1")
    got = {r.doc_id: r for r in secrets.secret_digest(rows).collect()}
    for doc_id, text in rows_of(rows):
        want = base_spans(text)
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, e, n in want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(n == k for *_, n in want) for k in ("assign", "access", "hex")]
    assert got[10].n_live == 3 and got[10].spans.count("assign") == 1
    assert got[11].spans == "hex:5:45"
    assert all(got[20 + i].n_copied == 1 for i in range(4))
    assert secrets.secret_digest(empty).count() == 0
    assert secrets.secret_digest(rough).count() == rough.count()


def test_redaction(rough):
    got = {r.doc_id: r for r in secrets.redact_live(rough).collect()}
    before = {r.doc_id: r for r in rough.collect()}
    assert "f3ef" not in got[10].text and "AKIA" not in got[10].text and got[10].text.endswith(". ünï secret: token: abcdefghij")
    assert got[11].text == "seen [SECRET] again"
    assert all(got[i] == before[i] for i in before if i not in (10, 11))


def test_bare_token_of_a_live_secret(spark):
    docs = spark.createDataFrame([(1, "token: Qw3rTy8uIoP4aSdF9", "a"), (2, "left Qw3rTy8uIoP4aSdF9 here", "b"), (3, "left Zw3rTy8uIoP4aSdF9 here", "b")],
                                 "doc_id long, text string, source string")
    got = {r.doc_id: r.spans for r in secrets.secret_digest(docs).collect()}
    assert got[1] == "assign:0:24" and got[3] == ""
    assert got[2] == ""  # two owners hold it now, so it is shared
    alone = docs.withColumn("source", docs["doc_id"].cast("string").substr(1, 0))
    assert {r.doc_id: r.spans for r in secrets.secret_digest(alone).collect()} == {1: "assign:0:24", 2: "bare:5:22", 3: ""}


# 10 repeats

def brute_repeats(texts, length):
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(rough, empty):
    rows = rough.collect()
    want = Counter((r.doc_id, *b) for r, b in zip(rows, brute_repeats([(r.text or "").encode() for r in rows], 200)))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeats_digest(rough).collect())
    assert got == want and any(k[2] for k in want)
    assert suffixes.repeats_digest(empty).count() == 0


def test_repeats_over_several_shards(spark):
    rng = np.random.default_rng(6)
    passage = bytes(rng.integers(97, 123, 500, np.uint8)).decode()
    texts = [bytes(rng.integers(97, 123, rng.integers(1, 80), np.uint8)).decode() + passage[rng.integers(0, 150):rng.integers(320, 500)] + f"{rng.integers(1e9)}" * 3
             for i in range(120)] + ["xy" * 200, passage + "é" + passage]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {i: b[1] for i, b in enumerate(brute_repeats([t.encode() for t in texts], 200))}
    for contexts in (3, 10_000):  # shards that hold next to nothing, and one that holds all
        cut = suffixes.without_repeats(docs, shard_contexts=contexts).join(suffixes._by_text(docs, "text").select("doc_id", "uid"), "uid")
        assert {i: 0 for i in want} | {r.doc_id: r.n_removed for r in cut.collect()} == want


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(20):
        strings = [bytes(rng.integers(97, 99, rng.integers(1, 40), np.uint8)) for _ in range(rng.integers(1, 7))]
        strings.append(strings[0])
        data, starts = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
        order, rank = suffixes.suffix_array(data, starts)
        tails = [(s[i:], k) for k, s in enumerate(strings) for i in range(len(s))]
        want = sorted(range(len(tails)), key=lambda p: [*(c + 1 for c in tails[p][0]), tails[p][1] - 1000])
        assert order.tolist() == want and (rank[order] == np.arange(len(want))).all()
        shared = suffixes.common_prefixes(data, starts, order, rank)
        for j in range(1, len(want)):
            a, b = tails[want[j]][0], tails[want[j - 1]][0]
            assert shared[j] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
