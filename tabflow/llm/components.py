"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settled


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (src, dst) and the smallest node it can reach.

    Large-star and small-star steps alternate until nothing changes.  Each is a
    partial minimum by node and, with the minima written to the shared folder, an
    equi-join of two plain exchanges, which AQE can split: a node with very many links
    is no one task's burden.
    Links with a null end are ignored; links of a node to itself make it its own root.
    """
    edges = links.filter("src is not null and dst is not null")
    first = edges = settled(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    digest = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    now = digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settled(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        # Large star: every larger neighbour links to the smallest node around.
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = settled(large.distinct(), "large")
        # Small star: a node and its smaller neighbours link to the smallest of them.
        least = settled(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        new = settled(small.select("e.u", "e.v").filter("u <> v").distinct(), "round")
        then, now = now, digest(new)
        drop_settled(low, large, least, *([] if edges is first else [edges]))
        edges = new
        if now == then:
            break
    return nodes.join(edges.groupBy("u").agg(F.min("v").alias("m")), F.col("node") == F.col("u"), "left").select("node", F.coalesce("m", "node").alias("root"))
