"""Canonical exact digests of texts, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, for_each_row, ordered_index, settled, with_row_ids

#: Rows of a table of ids that may be broadcast (8 bytes each); more are shuffled.
SENT = 2_000_000


def canonical(text: Column) -> Column:
    """A text with its Unicode form, case and white space folded.

    NFKC, full case folding, and NFKC again (folding may undo it); runs of white space
    become one space, none at the ends.  An ASCII text needs lower-casing only.  The
    Unicode functions are those of the ICU library that Spark ships for collations.
    """
    icu = lambda cls, method, x: F.reflect(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), x, F.lit(True))
    text = F.coalesce(text, F.lit(""))
    compose = lambda x: icu("text.Normalizer", "compose", x)
    folded = F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(compose(icu("lang.UCharacter", "foldCase", compose(text))))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x85\x1c-\x1f]+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits in 32 hex digits: XXH64 under two seeds."""
    digits = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.concat(digits(F.xxhash64(canon)), digits(F.xxhash64(F.lit("wide"), canon)))


def _buckets(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rid, fp), (fp, group)) of ``texts`` (rid, text): hashes, and first rids of hashes met twice or more."""
    hashes = settled(texts.select("rid", wide_hash(canonical(F.col("text"))).alias("fp")), "hashes")
    return hashes, settled(hashes.groupBy("fp").agg(F.min("rid").alias("group"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp", "group"), "buckets")


def _collided(texts: DataFrame, hashes: DataFrame, buckets: DataFrame) -> DataFrame:
    """The hashes (fp) whose texts differ in their canonical bytes.

    Only texts of buckets with two rows or more are compared: each task keeps the least
    and the greatest bytes of a bucket, so a large group of copies is folded where it is.
    """
    members = settled(hashes.join(buckets, "fp", "left_semi").select("rid"), "members")
    sent = F.broadcast(members) if members.count() <= SENT else members
    canon = texts.join(sent, "rid", "left_semi").select(canonical(F.col("text")).alias("canon"))
    bounds = canon.groupBy(wide_hash(F.col("canon")).alias("fp")).agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    return settled(bounds.filter("low <> high").select("fp"), "collided")


def _separate(hashes: DataFrame, texts: DataFrame, collided: DataFrame) -> DataFrame:
    """(rid, fp) with the texts of collided hashes told apart by a second digest; there are hardly ever any."""
    odd = hashes.join(collided, "fp", "left_semi")
    told = odd.join(texts, "rid").select("rid", F.concat("fp", F.lit("-"), F.sha2(canonical(F.col("text")), 256)).alias("told"))
    return hashes.join(told, "rid", "left").select("rid", F.coalesce("told", "fp").alias("fp"))


def fingerprints(texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((rid, fp), collided or None): texts with equal canonical bytes, and no others, have equal fp."""
    hashes, buckets = _buckets(texts)
    collided = _collided(texts, hashes, buckets)
    if collided.isEmpty():
        return hashes, None
    return settled(_separate(hashes, texts, collided), "separate"), collided


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, group_id): documents with equal canonical texts.

    group_id is the smallest doc_id of the group (null if none has an id).  Null and
    empty texts are equal; repeated rows are copies of each other, and each returns.
    """
    own, unique = with_row_ids(documents(docs, id_col, text_col))
    texts = own.select("rid", "text") if unique else own.select("rid", "text").dropDuplicates(["rid"])
    found, _ = fingerprints(texts)
    rows = for_each_row(found, own, unique)
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("group_id"))
    return rows.join(groups, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "group_id")


def likeness_to_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint beside those of its edited text and of the next document.

    The next document has the next smaller doc_id, the smallest is followed by the
    largest; the edited text has the last third of the code points replaced by as many
    first ones of the next document's, or all it has.  Returns (doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); an exact
    digest is like another (1.0) or not (0.0).  Rows that repeat a doc_id and a text are
    one document; a single document is its own next one.

    Texts are shuffled once, by rid, and that exchange serves both joins; of the next
    document only the part that is used moves on.
    """
    own, unique = with_row_ids(documents(docs, id_col, text_col))
    texts = own.select("rid", "text") if unique else own.select("rid", "text").dropDuplicates(["rid"])
    found, collided = fingerprints(texts)
    hashed = texts.withColumn("fp", wide_hash(canonical(F.col("text")))) if collided is None else texts.join(found, "rid")

    places = settled(ordered_index(texts.select("rid"), ["rid"]), "places")
    n = places.count()
    after = places.select(F.col("rid").alias("next_rid"), "index")
    # next_rid serves the row above it in the order of ids; rid 0 is served by the last.
    pairs = places.select("rid", F.pmod(F.col("index") - 1, F.lit(max(n, 1))).alias("index")).join(after, "index").select("rid", "next_rid")
    third = texts.select("rid", F.floor(F.char_length("text") / 3).cast("int").alias("third"))
    wanted = settled(pairs.join(third, "rid"), "wanted")

    taken = wanted.withColumnRenamed("rid", "for_rid").join(hashed, F.col("next_rid") == F.col("rid"))
    taken = taken.select("for_rid", "third", F.col("fp").alias("next_fp"), F.col("text").substr(F.lit(1), F.col("third")).alias("taken"))
    both = hashed.join(taken, F.col("rid") == F.col("for_rid"))
    kept = F.col("text").substr(F.lit(1), F.char_length("text") - F.col("third"))
    both = both.select("rid", "fp", "next_fp", F.char_length("text").cast("long").alias("n_chars"), F.concat(kept, "taken").alias("edited"), F.col("text"))
    both = both.withColumn("canon", canonical(F.col("edited"))).withColumn("edited_fp", wide_hash(F.col("canon")))
    same_bytes = F.col("canon") == canonical(F.col("text"))
    base = F.substring("fp", 1, 32)  # without what tells collided texts apart
    out = both.select(
        "rid",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        F.when((F.col("edited_fp") == base) & same_bytes, F.col("fp")).otherwise(F.col("edited_fp")).alias("edited_fingerprint"),
        F.when(F.col("edited_fp") == base, same_bytes.cast("double")).otherwise(0.0).alias("near_edited"),
        (F.col("fp") == F.col("next_fp")).cast("double").alias("near_next"),
    )
    return for_each_row(out, own, unique)
