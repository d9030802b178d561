"""SimHash near-duplicate classes of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled
from .components import connected_components
from .fingerprints import fingerprints
from .similar import similar_classes
from .triejoin import near_links


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2, tables: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    Documents whose SimHash differs in at most ``budget`` bits are linked.  Several
    ``tables`` ask for more than SimHashes can find: documents are then linked where 0.8
    or more of their shingles are shared, all of them and no others; SimHashes within
    ``budget`` bits in one of the tables are what is compared first, and an exact search
    finds the rest (``similar``).  component_id is the smallest doc_id that links
    reach, the document's own included; fp is the first SimHash.  Documents whose
    fingerprints (or sets of shingles) are equal are folded to one node before the join and
    unfolded after it, so a large group of copies costs one node.  Texts without words
    share fingerprint 0.  A document with a null id follows its fingerprints, or has a null
    component if no document with them has an id.  Repeated rows are returned as often
    as they are given; an empty table gives no rows.
    """
    if tables > 1:
        return similar_classes(docs, words, 80, budget, tables, id_col, text_col)
    fps = settled(fingerprints(docs, words, tables, id_col, text_col), "fingerprints")
    nodes = settled(fps.groupBy("fps").agg(F.min("doc_id").alias("node")), "nodes")
    known = nodes.filter("node is not null")
    links = near_links(known.select(F.posexplode("fps").alias("part", "fp"), "node"), budget)
    # A doc_id that is given to two texts would be a node twice: the smaller of the nodes it joins is right for both.
    roots = connected_components(links)
    classes = nodes.join(roots, "node", "left").select("fps", F.coalesce("root", "node").alias("component_id"))
    return fps.join(classes, "fps", "left").select("doc_id", F.element_at("fps", 1).alias("fp"), "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The documents of ``docs`` that represent their class: the row of the smallest doc_id.

    Rows that repeat that doc_id all stay, and so do documents without an id.
    """
    id_col = options.get("id_col", "doc_id")
    kept = near_duplicates(docs, **options).filter("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    # The documents' own columns go into one, so that none can clash.
    rows = docs.select(F.struct(*(docs[f"`{c.replace('`', '``')}`"] for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"))
    stay = rows.join(kept, F.col("id") == F.col("kept"), "left").filter(F.col("kept").isNotNull() | F.col("id").isNull())
    return stay.select("row.*")
