"""Alignment of two tokenizers, line dedup and bit-plane clustering against brute force, on rough and on empty tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tesserix.llm import alignment, bitplanes, lines

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 alignment

@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PATHS[1])


def groups_of(tokenizers, text):
    """[(A ids, B ids)] by the tokenizers' own libraries, token by token; None without tokens."""
    a, b = tokenizers
    if not text:
        return None
    raw = (" " + text).encode()
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in kept} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(kept)))}
    x = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        y.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()))
    if b"".join(v for _, v in x) != raw or b"".join(v for _, v in y) != raw:
        return None
    out, ga, gb, pa, pb, i, j = [], [], [], 0, 0, 0, 0
    while i < len(x) or j < len(y):
        if pa <= pb:
            ga.append(x[i][0])
            pa += len(x[i][1])
            i += 1
        else:
            gb.append(y[j][0])
            pb += len(y[j][1])
            j += 1
        if pa == pb and ga and gb:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def aligned(tokenizers, rows):
    groups = [groups_of(tokenizers, t) for _, t in rows]
    count = Counter(p for g in groups if g for p in {(a, b) for x, y in g for a in x for b in y})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (doc, _), g in zip(rows, groups):
        links = [(a, b) for x, y in g or [] for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        out.append((doc, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), len(links),
                    sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha(text) if g else ""))
    return sorted(out, key=str)


ODD = ["  two  spaces ", " ", "\n", "tab\there \x1c odd \x85 white", "special <|endoftext|> and <s> </s> <unk>", "mark ▁ here", "▁", "日本語 テキスト", "naïve café ﬁ",
       "emoji 🙂🙂 ‍ family", "don't we'll I'M", "\r\n a b　c", "<0x41>", "1 234,5 ½ ²", "ab" * 3000, "a" * 4000, "x\x00y", "ꟍ new letter"]


def test_alignment(spark, rough, tokenizers):
    docs = rough.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    want = aligned(tokenizers, rows)
    for kwargs in ({}, {"shards": 3}):
        got = alignment.alignment_digest(docs, *PATHS, **kwargs)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert any(r[1] == 0 and r[0] == 105 for r in want) and sum(r[1] > 0 for r in want) > 60


def test_alignment_of_many_chunks_and_wide_groups(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_ROWS", 2)
    monkeypatch.setattr(alignment, "FAN", 3)
    rows = [(i, f"word{i % 7} and the other {i % 3} words, Vergleich übung {'z' * (i % 9)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = alignment.alignment_digest(docs, *PATHS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == aligned(tokenizers, rows)
    encoders, sizes = alignment.loaded(*PATHS)
    a, b = encoders.encoded(["ab" * 3000])[0]
    plain = alignment.Alignment(sizes, np.array([len(a)]), np.array([len(b)]), a, b).pairs()
    monkeypatch.setattr(alignment, "WIDE_GROUP", 0)
    wide = alignment.Alignment(sizes, np.array([len(a)]), np.array([len(b)]), a, b).pairs()
    assert all((p == w).all() for p, w in zip(plain, wide))


def test_alignment_of_nothing(spark, empty, tokenizers):
    assert alignment.alignment_digest(empty, *PATHS).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert [r.n_a for r in alignment.alignment_digest(nothing, *PATHS).collect()] == [0, 0, 0]


def test_very_long_text_is_aligned(tokenizers):
    text = "lorem ipsum dolor " * 60000
    encoders, sizes = alignment.loaded(*PATHS)
    a, b = encoders.encoded([text])[0]
    block = alignment.Alignment(sizes, np.array([len(a)]), np.array([len(b)]), a, b)
    assert block.totals()[0, 2] > 100000 and len(block.pairs()[1]) < 60


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 50000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 32, n).astype(np.uint32))
        h = alignment.PerfectHash.loads(alignment.PerfectHash.build(keys).dumps())
        slots = h.slots(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        by_slot = np.zeros(len(keys), np.uint32)
        by_slot[slots] = keys
        assert (h.verified(keys, by_slot) == slots).all()
        if n > 1:
            with pytest.raises(ValueError):
                h.verified(np.setdiff1d(np.arange(50, dtype=np.uint32), keys), by_slot)


def test_perfect_hash_with_spare_keys(monkeypatch):
    monkeypatch.setattr(alignment, "_LEVELS", 1)
    keys = np.arange(0, 3000, 3, dtype=np.uint32)
    h = alignment.PerfectHash.loads(alignment.PerfectHash.build(keys).dumps())
    assert len(h.spare) and sorted(h.slots(keys).tolist()) == list(range(1000))


# 12 lines

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def deduped(rows, least=10):
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(WHITE).translate(LOWER)
            if len(key) >= least:
                first[key] = min(first.get(key, math.inf), math.inf if doc is None else doc)
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        keys = [p.strip(WHITE).translate(LOWER) for p in parts]
        kept = [p for p, k in zip(parts, keys) if len(k) < least or first[k] == (math.inf if doc is None else doc)]
        out.append((doc, len(parts), len(parts) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def line_rows():
    rng = np.random.default_rng(3)
    pool = [f"Line number {i} of the pool" for i in range(40)] + ["short", "", "  padded LINE of text\t", "padded line of text", "ÄÖÜ zehn Zeichen", "äöü zehn zeichen"]
    rows = [(i, "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 30)))) for i in range(80)]
    long = "\n".join(f"own line {i} {'again' if i % 3 else i}" for i in range(20000))
    rows += [(200, long), (201, long + "\n"), (200, long), (None, long), (None, None), (300, ""), (301, "\n\n"), (5, "Line number 1 of the pool\nnew here"), (302, "a line with\r\nreturns in it\r\na line with")]
    return rows + [(400 + i, "a line that is everywhere\nother line " + str(i % 50)) for i in range(300)]


@pytest.mark.parametrize("frequent", [1, 1000])
def test_lines(spark, frequent):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in lines.lines_digest(docs, frequent=frequent).collect()), key=str) == deduped(rows)


def test_lines_by_both_routes(spark):
    """One frequent line by the broadcast route, all others by the sorted one."""
    rows = line_rows()
    table = lines.line_hashes(spark.createDataFrame(rows, "doc_id long, text string"))
    routes = [{tuple(r) for r in lines.later_lines(table, f).select("doc_id", "text_1", "pos").collect()} for f in (1, 1000)]
    assert routes[0] == routes[1] and len(routes[0]) > 20000


def test_lines_rough(rough, empty):
    rows = [(r.doc_id, r.text) for r in rough.collect()]
    assert sorted((tuple(r) for r in lines.lines_digest(rough).collect()), key=str) == deduped(rows)
    assert lines.lines_digest(empty).count() == 0


def test_line_bitmaps_are_sparse(spark):
    text = "\n".join(f"unique line {i}" for i in range(1000))
    docs = spark.createDataFrame([(1, "shared line here"), (2, text + "\nshared line here")], "doc_id long, text string")
    row = lines.keep_bitmaps(docs).collect()
    assert [(r.doc_id, r.n_dropped, [(w.word, w.bits) for w in r.keep]) for r in row] == [(2, 1, [(15, ~(1 << 40))])]
    got = {r.doc_id: (r.text, r.kept) for r in lines.with_kept_text(docs, lines.keep_bitmaps(docs)).collect()}
    assert got[2] == (text + "\nshared line here", text) and got[1][1] == "shared line here"


# 13 clusters

def clustered(rows, k=16, rounds=3):
    kept = [(i, [math.floor(x * 64) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((sha(f"1:{i}"), dict(rows)[i], v) for i, v in kept if i is not None)[:k]
    centroids = [v for *_, v in starts]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(c) // len(members[n]) for c in zip(*members[n])] if n in members else old for n, old in enumerate(centroids)]
    done = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in done:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha(",".join(map(str, centroids[n])))) for i, d, n in done), key=str)


def vector_rows(n=300):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(i % 5, 1, 64).astype(np.float32).tolist()) for i in range(n)]
    bad = [(n, None), (n + 1, []), (n + 2, [1.0] * 63), (n + 3, [None] + [1.0] * 63), (n + 4, [float("nan")] + [1.0] * 63), (n + 5, [float("inf")] * 64)]
    return rows + bad + [(None, [0.5] * 64), (7, rows[7][1]), (8, rows[8][1]), (n + 6, [-0.0] * 64), (n + 7, [-1e-9] * 64)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters(spark, kind):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string").repartition(3)
    want = clustered(rows)
    assert sorted((tuple(r) for r in bitplanes.cluster_digest(df).collect()), key=str) == want and len({w[1] for w in want}) > 3


def test_clusters_of_large_components(spark):
    rows = [(i, [float((-1) ** (i * j) * 2.0 ** (15 + (i + j) % 7)) for j in range(64)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in bitplanes.cluster_digest(df).collect()), key=str)
    assert got == clustered(rows)
    huge = [(i, [v * 2.0 ** 90 for v in r]) for i, r in rows]
    planes = bitplanes.to_planes(bitplanes.whole_numbers(np.array([r for _, r in huge[:6]])))
    exact = [[math.floor(x) * 64 for x in r] for _, r in huge[:6]]
    assert bitplanes.distances(planes, planes).tolist() == [[sum((a - b) ** 2 for a, b in zip(x, y)) for y in exact] for x in exact]
    got = bitplanes.cluster_digest(spark.createDataFrame(huge[:20], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 20 and {r.distance for r in got if r.distance is not None} <= {0}


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert bitplanes.cluster_digest(spark.createDataFrame([], schema)).count() == 0
    rows = vector_rows()[:3]
    assert sorted((tuple(r) for r in bitplanes.cluster_digest(spark.createDataFrame(rows, schema)).collect()), key=str) == clustered(rows)
    none = bitplanes.cluster_digest(spark.createDataFrame([(None, [0.5] * 64)], schema)).collect()
    assert [(r.vec_id, r.cluster, r.distance) for r in none] == [(None, None, None)]


def test_planes_give_sums_and_dots():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (500, 64))
    planes, cluster = bitplanes.to_planes(x), rng.integers(0, 5, 500)
    assert (bitplanes.dots(planes, planes[:7], np.int64) == x @ x[:7].T).all()
    assert (bitplanes.squares(planes, np.int64) == (x * x).sum(axis=1)).all()
    assert all((bitplanes.component_sums(planes, cluster, 5)[c] == x[cluster == c].sum(axis=0)).all() for c in range(5))
