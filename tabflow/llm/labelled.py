"""Bounded samples of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document's label is set aside for testing: crc32 of its id as text divides by 5."""
    return F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 5 == 0


def training_labels(labels: DataFrame, label_col: str, bound: int, by_class: bool, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most ``bound`` labelled ids that are not held out.

    Ids are taken in the order of a hash, so the sample is the same in every run and
    as good as random; with ``by_class``, at most half are of each class.  A null id or
    label is left out, an id with contradicting labels gets the larger.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id"))
    take = lambda r, n: r.orderBy(F.xxhash64("id"), "id").limit(n)
    if by_class:
        rows = take(rows.filter("label = 1"), bound // 2).unionByName(take(rows.filter("label = 0"), bound // 2))
    else:
        rows = take(rows, bound)
    return rows.groupBy("id").agg(F.max("label").alias("label"))


def training_documents(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, by_class: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of the sample's documents; the bounded list of ids is broadcast."""
    ids = training_labels(labels, label_col, bound, by_class, id_col)
    return documents(docs, id_col, text_col).join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label")
