"""Registered queries of the corpus operators: name -> (Spark callable, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.llm.alignment import alignment_digest, file_chunks
from tesserix.llm.backoff import SHARD_ROWS, backoff_scores
from tesserix.llm.bitplanes import cluster_digest
from tesserix.llm.common import documents
from tesserix.llm.jaccard import classes
from tesserix.llm.lines import lines_digest
from tesserix.llm.media import audio_digest
from tesserix.llm.mixing import mix_digest
from tesserix.llm.neighbours import nearest
from tesserix.llm.packing import pack
from tesserix.llm.secrets import secret_digest
from tesserix.llm.sharding import shard_digest
from tesserix.llm.sql import OP3, OP4, OP6, OP9, OP12, OP13
from tesserix.llm.suffixes import repeats_digest
from tesserix.llm.toxicity import toxicity_digest


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(documents(spark, sf_dir))


def op3_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op4_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Shards follow the files, so that a task meets whole shards; the text is moved once, with the answers.
    docs = documents(spark, sf_dir)
    scores = backoff_scores(docs, shard=F.xxhash64("_metadata.file_path", F.expr(f"_metadata.row_index div {SHARD_ROWS}")))
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digest(documents(spark, sf_dir))


def op8_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(documents(spark, sf_dir))


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(documents(spark, sf_dir))


def op11_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment_digest(documents(spark, sf_dir), *paths, chunk=file_chunks())


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_digest(documents(spark, sf_dir))


def op13_bitplane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_lexicon_toxicity": (op1_lexicon_toxicity, None),
    "op2_source_mixing": (op2_source_mixing, None),
    "op3_block_neighbours": (op3_block_neighbours, OP3),
    "op4_backoff_scores": (op4_backoff_scores, OP4),
    "op5_hilbert_shards": (op5_hilbert_shards, None),
    "op6_jaccard_join": (op6_jaccard_join, OP6),
    "op7_audio_features": (op7_audio_features, None),
    "op8_ordered_packing": (op8_ordered_packing, None),
    "op9_secret_ownership": (op9_secret_ownership, OP9),
    "op10_suffix_repeats": (op10_suffix_repeats, None),
    "op11_cross_alignment": (op11_cross_alignment, None),
    "op12_line_dedup": (op12_line_dedup, OP12),
    "op13_bitplane_clusters": (op13_bitplane_clusters, OP13),
}
