"""From raw documents to packed training sequences: toxicity, near copies, secrets, mixing, packing.

Each stage reads what its predecessor kept, as a stored table. All but the last return the columns of ``documents``. A stage begins
by deleting the intermediate tables of the one before it: that one's output is stored, so nothing reads them any more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tesserix.llm.jaccard import one_of_each
from tesserix.llm.mixing import mixed_documents
from tesserix.llm.packing import pack
from tesserix.llm.secrets import redact_live
from tesserix.llm.toxicity import without_toxic
from tesserix.session import drop_tables, recorded_tables, shared_folder

#: Name of the packing vocabulary among the public tokenizers.
VOCABULARY = "word_bpe_49k.json"


_LEFT: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _LEFT)
        with recorded_tables() as made:
            out = work(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out

    return run_stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The lexicon is learned from the labels of this input."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays (five-word shingles, similarity 0.8)."""
    return one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials of one owner are masked; every document stays."""
    return redact_live(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _stage(toxicity)),
    ("ngram_jaccard_join", _stage(near_copies)),
    ("secret_scan", _stage(secret_scan)),
    ("source_mixing", _stage(mixing)),
    ("packing", _stage(packing)),
]

#: SQL cannot express the learned lexicon, the permutations and the packing; tests/llm compares each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
