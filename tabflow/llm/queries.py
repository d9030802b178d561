"""The registered queries of the training-data operators.

Each applies its operator to a whole table with production parameters and derives
the digest columns that its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, digests, licenses, neardup, neighbours, packing, passages, quality_rules, sharding, toxicity
from .labelled import held_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes: 3-word shingles, fingerprints within 2 bits."""
    out = neardup.near_duplicates(docs(spark, sf_dir), words=3, budget=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 contiguous shards of nearly equal bytes."""
    return sharding.shard_documents(docs(spark, sf_dir), 16)


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048)


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    out = bpe.round_trip(docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, the base rules' verdict and the label model's."""
    return quality_rules.score_quality(docs(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    own, labels = docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(own, toxicity.train(own, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    own, labels = docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = neighbours.score(own, neighbours.train(own, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that 100-byte strings seen earlier cover, removed."""
    out = passages.remove_repeats(docs(spark, sf_dir), 100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that whole texts and lines are."""
    return licenses.scan(docs(spark, sf_dir))


ORACLE_SQL["op1_license_scan"] = licenses.oracle_sql()


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of texts and of their edits."""
    return digests.likeness_to_edits(docs(spark, sf_dir))
