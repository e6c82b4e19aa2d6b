"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

The lexicon is learned: a few seed words, and whole words and word beginnings that stand out in texts labelled toxic, weighted
by log-odds. Text and lexicon are folded alike: lower case, no accents, look-alike letters and digit substitutions read as Latin letters, l
as i (1 stands for both). Substitutes that end a word may also be a number or punctuation ("a1", "stupid$$$"): they are read as letters where
that makes a term. Hits inside an exception phrase don't count. The summed weights, alone and by length, give the score through a fitted logistic curve.

Null and empty texts get the score of a text without hits. Rows repeat in the result as they do in the input; ties don't arise.
Without labels of both kinds only the seed words are known and every score is the share of toxic labels, below one half.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.session import cut_lineage

#: The model is fitted on at most so many labelled rows, those of the smallest hash of their id.
FIT_ROWS = 20_000
MAX_TERMS = 4096
#: A term must stand out by so many standard errors of its log-odds that one in a hundred corpora would show any such term by
#: chance (the border grows with the number of terms looked at), by this at least.
LEAST_Z, BY_CHANCE = 3.0, 0.01
#: Of the labelled texts with the term, so many must be toxic: words of a language or topic that is a little more often toxic
#: stay out, however sure their log-odds are.
LEAST_SHARE = 0.45
PREFIXES = (3, 4, 5, 6)
#: Terms whose counts a task holds before it hands them on.
HELD_TERMS = 200_000

#: Phrases in which words of abuse are harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "sore loser", "useful idiot", "moron test")

#: Words of abuse that count before any label is seen; where labelled texts hold them often enough, these decide.
SEED = ("idiot", "moron", "stupid", "trash", "scum", "loser", "clown", "pathetic", "disgusting", "worthless", "imbecile", "filth",
        "vermin", "dumbass", "asshole", "bastard", "bitch", "whore", "retard", "arschloch", "abschaum", "dummkopf", "connard",
        "salaud", "ordure", "cabron", "gilipollas", "imbecil")
SEED_WEIGHT = 4.0

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
_LOOKALIKES = dict(zip("абвгеёзикмнорстуухіјѕԁһοαερτυιν", "abbreezukmhopctyyxijsdhoaeptuiv", strict=True))
_DIGITS = str.maketrans("013457@$", "oieastas")
_ONE = str.maketrans("l", "i")
_COMBINING = re.compile("[̀-ͯ]+")
_LOOK = str.maketrans(_LOOKALIKES)
_LEET = re.compile(r"(?:(?<=[a-z])|(?<![a-z0-9@$]))[013457@$]+(?=[a-z])")
_FINAL = re.compile(r"([a-z0-9]*[a-z])([013457@$]+)(?![a-z0-9@$])")
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None, known: Callable[[str, int], bool] | None = None) -> str:
    """Words of the folded text between single spaces, with one space at either end. Substitutes at the end of a word are
    letters where ``known`` says so of the word with them and its length without."""
    t = (text or "").lower()
    if not t.isascii():
        t = _COMBINING.sub("", unicodedata.normalize("NFKD", t)).translate(_LOOK)
    t = _LEET.sub(lambda m: m[0].translate(_DIGITS), t).translate(_ONE)
    if known:
        t = _FINAL.sub(lambda m: w if known(w := m[1] + m[2].translate(_DIGITS), len(m[1])) else m[0], t)
    return f" {_GAP.sub(' ', t).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """Terms start with a space; those that end with one are whole words, the others word beginnings."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def folded_terms(self) -> dict[str, float]:
        """Terms with l as i; the heaviest of those that become one."""
        folded: dict[str, float] = {}
        for term, weight in self.terms.items():
            key = term.translate(_ONE)
            folded[key] = max(weight, folded.get(key, weight))
        return folded

    def known(self) -> Callable[[str, int], bool]:
        """Whether a word, read with its last letters from ``start`` on, is a term or has a beginning that needs them."""
        terms = self.folded_terms()
        longest = max((len(t) for t in terms), default=0)
        return lambda word, start: f" {word} " in terms or any(f" {word[:k]}" in terms for k in range(start + 1, min(len(word), longest) + 1))

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.folded_terms().items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(fold(phrase), (len(fold(phrase)), -1.0))
        found.make_automaton()
        return found


def hits(automaton: ahocorasick.Automaton, folded: str) -> tuple[float, int]:
    """Summed weight and number of the words hit: the heaviest term counts for a word, none inside an exception phrase."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight < 0:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for a, b in spared:  # positions are the spaces before words
        for start in [s for s in best if a <= s < b]:
            del best[start]
    return sum(best[s] for s in sorted(best)), len(best)


def _features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], axis=1)


def _measured(docs: DataFrame, lexicon: Lexicon, text: str) -> DataFrame:
    @F.pandas_udf("weight double, words int, hits int")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton, known = lexicon.automaton(), lexicon.known()
        for texts in batches:
            rows = []
            for x in texts:
                folded = fold(x, known)
                rows.append((*(hits(automaton, folded)), folded.count(" ") - 1 if len(folded) > 2 else 0))
            yield pd.DataFrame([(w, n, k) for w, k, n in rows], columns=["weight", "words", "hits"])

    return docs.withColumn("_tox", measure(F.col(text)))


def _terms(text: str | None) -> set[str]:
    """Terms of either reading of the text."""
    ended: set[str] = set()
    words = set(fold(text, lambda word, _: ended.add(word)).split()) | ended
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) >= k}


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """(text, toxic, part): labelled rows outside the held-out fifth, at most ``bound`` of them; one label per document."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL AND pmod(crc32(CAST(doc_id AS STRING)), 5) <> 0")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # At most ``bound`` ids and labels are broadcast, so no text is shuffled.
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(
        "text", "toxic", F.expr("pmod(xxhash64(doc_id, 7), 4)").alias("part"))


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Terms from three quarters of the training rows, the curve from the rest. What reaches the driver is bounded by
    ``MAX_TERMS`` and ``FIT_ROWS``."""
    train = cut_lineage(training_rows(docs, labels), "training")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def told() -> Iterator[pd.DataFrame]:
            terms = list(seen[0].keys() | seen[1].keys())
            for at in range(0, len(terms), 50_000):
                some = terms[at:at + 50_000]
                yield pd.DataFrame({"term": some, "clean": [seen[0][t] for t in some], "toxic": [seen[1][t] for t in some]})
            seen[0].clear(), seen[1].clear()

        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                seen[int(toxic > 0)].update(_terms(text))
                seen[int(toxic > 0)][""] += 1  # the empty term counts texts
                if len(seen[0]) + len(seen[1]) > HELD_TERMS:
                    yield from told()
        yield from told()

    counts = train.filter("part < 3").select("text", "toxic").mapInPandas(count, "term string, clean long, toxic long").groupBy(
        "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    seeds = [fold(w) for w in SEED]
    counts = counts.filter((F.col("toxic") >= 2) | F.col("term").isin("", *seeds))
    total = counts.filter("term = ''").select(F.col("clean").alias("all_clean"), F.col("toxic").alias("all_toxic"))
    odds = counts.filter("term <> ''").crossJoin(F.broadcast(total)).withColumn(  # ``total`` is one row
        "weight", F.expr("ln((toxic + 0.5) / (all_toxic + 1)) - ln((clean + 0.5) / (all_clean + 1))")).withColumn(
        "z", F.expr("weight / sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))"))
    odds = cut_lineage(odds, "odds")
    border = max(LEAST_Z, NormalDist().inv_cdf(1 - BY_CHANCE / max(odds.count(), 1)))
    chosen = odds.filter((F.col("z") >= border) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean")))).orderBy(
        F.desc("z"), "term").limit(MAX_TERMS).collect()
    terms = {w: SEED_WEIGHT for w in seeds}
    for r in odds.filter(F.col("term").isin(seeds)).collect():
        if r.clean >= 3 and r.z < LEAST_Z:
            del terms[r.term]
    # The surest first; what begins with a chosen beginning says nothing new.
    beginnings: set[str] = set()
    for r in chosen:
        if not any(r.term[:k] in beginnings for k in range(2, len(r.term))):
            terms[r.term] = r.weight
            if not r.term.endswith(" "):
                beginnings.add(r.term)
    lexicon = Lexicon(terms, exceptions)
    rest = _measured(train.filter("part = 3"), lexicon, "text").select("toxic", "_tox.weight", "_tox.words").collect()
    label = np.array([float(r.toxic > 0) for r in rest])
    x = _features(np.array([r.weight for r in rest], float), np.array([r.words for r in rest], float))
    return Lexicon(lexicon.terms, exceptions, tuple(float(v) for v in _logistic(x, label)))


def _logistic(x: np.ndarray, label: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps with a ridge on all but the constant; the share of toxic rows where a class is missing."""
    beta = np.zeros(x.shape[1])
    if len(label) == 0 or label.min() == label.max():
        share = np.clip(label.mean() if len(label) else 0.0, 1e-3, 0.499)
        beta[0] = np.log(share / (1 - share))
        return beta
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (label - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` plus ``out`` (score, hits): probability of label 1, and how many words hit."""
    a, b, c = lexicon.curve
    z = F.lit(a) + F.lit(b) * F.log1p("_tox.weight") + F.lit(c) * F.log1p(100 * F.col("_tox.weight") / F.greatest(F.col("_tox.words"), F.lit(1)))
    return _measured(docs, lexicon, text).withColumn(out, F.struct(
        (1 / (1 + F.exp(-z))).alias("score"), F.col("_tox.hits").alias("hits"))).drop("_tox")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", F.expr("coalesce(pmod(crc32(CAST(doc_id AS STRING)), 5) = 0, false)").alias("held_out"),
                        F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
                        F.col("toxicity.hits").alias("hits"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score stays under one half."""
    return score(docs, fit(docs, labels), out="_found").filter("_found.score < 0.5").select(*docs.columns)
