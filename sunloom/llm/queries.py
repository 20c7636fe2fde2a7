"""The operators as queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.llm import fingerprint, hardnegatives, importance, linededup, mixing, neardup, packing, pii, quality, sharding, substrings, tokencounts, toxicity
from sunloom.llm.sql import SQL


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels(spark, sf_dir))).drop("text")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    return quality.judge(documents(spark, sf_dir).select("doc_id", "text")).select(*columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key="test key")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(documents(spark, sf_dir))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op9_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(documents(spark, sf_dir), vocabulary(), end=49407)


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op11_hardnegatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardnegatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_fingerprint": op5_fingerprint,
    "op6_pii": op6_pii,
    "op7_sharding": op7_sharding,
    "op8_linededup": op8_linededup,
    "op9_tokencounts": op9_tokencounts,
    "op10_neardup": op10_neardup,
    "op11_hardnegatives": op11_hardnegatives,
    "op12_substrings": op12_substrings,
    "op13_importance": op13_importance,
}

__all__ = ["QUERIES", "SQL"]
