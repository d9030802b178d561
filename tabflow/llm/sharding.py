"""Sharding by global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums


def contiguous_shards(df: DataFrame, size_col: str, key_cols: list[str], n_shards: int) -> DataFrame:
    """Deals rows out to contiguous shards of nearly equal total size.

    Rows are ordered by ``key_cols`` (nulls first, ties in any order).  Sizes are
    summed by range partition, the totals by prefix; row r, whose size begins at
    byte b of the whole, goes to shard ``floor((b + size / 2) * n_shards / total)``,
    so a cut is at most half a row from its target.  Adds ``shard`` and ``slot``
    (place in the shard, gapless from 0) behind the columns of ``df``; one of these that is
    called so gets ``_`` behind its name.  An empty table gives no rows; a single row
    that is longer than a shard leaves other shards empty.  Sizes must be positive.
    All columns of ``df`` are shuffled, so it should hold no texts; the driver sees one
    total for each partition and one first index for each shard.
    """
    keys = [f"key{k}" for k in range(len(key_cols))]
    own = df.select(F.struct(*(df[quoted(c)] for c in df.columns)).alias("row"), df[quoted(size_col)].cast("long").alias("size"), *(df[quoted(c)].alias(k) for c, k in zip(key_cols, keys, strict=True)))
    out = prefix_sums(own, keys, "size", "index", "begin")
    total = out.agg(F.max(F.col("begin") + F.col("size"))).first()[0] or 1
    middle = 2 * F.col("begin") + F.col("size")
    shard = F.least(F.floor(middle.cast("decimal(30,0)") * n_shards / F.lit(2 * total).cast("decimal(30,0)")).cast("int"), F.lit(n_shards - 1))
    out = out.withColumn("shard", shard)
    first = out.groupBy("shard").agg(F.min("index").alias("first_index"))  # n_shards rows
    out = out.join(F.broadcast(first), "shard").withColumn("slot", F.col("index") - F.col("first_index"))
    taken, names = {"shard", "slot"}, []
    for c in df.columns:
        name = c
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(F.col("row").getField(c).alias(name))
    return out.select(*names, "shard", "slot")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every document.

    size is the UTF-8 length of the text (null: 0) plus 1; the law is ``bytes``: the
    shards' sizes are near equal, so a group of equal texts is split where a cut falls.
    Rows are ordered by doc_id, null ids first; repeated rows each have a slot of their own.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = contiguous_shards(sizes, "size", ["doc_id", "text_crc32"], n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
