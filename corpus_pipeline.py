"""A corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gets, as ``docs``, all that the stage before
it kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm import neardup, neighbours, packing, passages, toxicity
from tabflow.llm.common import blocks, clear_settled, settled, settled_paths

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity scores under 0.5, by a model of those that have labels."""
    return toxicity.accept(docs, toxicity.train(docs, labels(spark, sf_dir)), 0.5)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours give them quality 0.3 or more."""
    return neighbours.accept(docs, neighbours.train(docs, labels(spark, sf_dir)), 0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest doc_id.

    Texts are linked if, and only if, 0.8 or more of their five-word shingles are shared;
    every document that goes had such a link.  Four SimHashes find most of them by the trie
    join; what it leaves is searched exactly, so their number moves work, not results.
    """
    return neardup.representatives(docs, words=5, budget=4, tables=4)


def whole_characters(kept: bytes, start: list[int], stop: list[int]) -> bytes:
    """``kept`` without the parts of characters that the cuts [start, stop) left beside them.

    The places are those in the text before cutting, in order.
    """
    parts, at, gone = [], 0, 0
    for k in range(len(start) + 1):
        end = start[k] - gone if k < len(start) else len(kept)
        lo, hi = at, end
        while k > 0 and lo < hi and kept[lo] & 0xC0 == 0x80:
            lo += 1
        if k < len(start):
            head = hi - 1
            while head >= lo and kept[head] & 0xC0 == 0x80:
                head -= 1
            if head >= lo and kept[head] >= 0xC0 and hi - head < (2 if kept[head] < 0xE0 else 3 if kept[head] < 0xF0 else 4):
                hi = head
            gone += stop[k] - start[k]
        parts.append(kept[lo:hi])
        at = end
    return b"".join(parts)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 100-byte strings that occur earlier.

    A character that a cut falls into goes as a whole; n_chars is counted anew.
    """
    kept = passages.remove_repeats(docs, 100, keep=("lang", "source"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            texts = [whole_characters(t, [s["start"] for s in cuts], [s["stop"] for s in cuts]) for t, cuts in zip(b.column("kept").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary()), b.column("lang"), b.column("source")], names=["doc_id", "kept", "lang", "source"])

    kinds = dict(docs.dtypes)
    kept = kept.select("doc_id", "kept", "spans", "lang", "source").mapInArrow(whole, f"doc_id long, kept binary, lang {kinds['lang']}, source {kinds['source']}")
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return kept.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]
#: No SQL expresses these stages; tests hold each against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = settled_paths()  # tables that are not this run's
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
        clear_settled(spark, docs, others=others)  # what the stage and those before it left on their way
    return STAGES[-1][1](spark, docs, sf_dir)
