"""Classes of texts whose sets of word shingles are similar: all links and no others.

Links are searched in three steps, each among what the steps before left apart:

1. SimHashes within a few bits, by the trie join: cheap, and most near copies are found.
2. Sets that share a member of their *prefixes*.  Sets whose Jaccard similarity is
   ``percent`` % or more always do: in one order of all shingles, a set's prefix is the first
   n - ceil(n * percent / 100) + 1 of its n.  The order puts shingles that a sample of
   documents often holds last, so common lines are in few prefixes.  The sample only moves
   work: any order finds the same pairs.  Each set is compared with the first and the last
   set that have its shingle, which joins most of a large class by few comparisons.
3. All pairs that share a shingle of their prefixes, may be similar by their sizes and by
   the shingle's places, and are not yet connected.

A pair that comes up is checked by maps first.  Each set has a map whose bits are turned by
the hashes of its shingles, one after another; the bits that differ between two maps bound
the shingles that differ from below, so most pairs of unlike sets go without a look at the
sets.  A map of SMALL bits travels with each row of step 3 and keeps pairs that cannot be
similar from ever being made; one as large as the set follows for those that are.  What
stays is compared by whole sets, by the XXH64 of each shingle.  Equal sets are one node,
named by the XXH64 of the set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, documents, settled, width
from .components import connected_components
from .fingerprints import fingerprint, shingle_hashes
from .triejoin import near_links

#: Documents in the sample, about; how many of them hold a shingle that counts as frequent; how many such are kept.
SAMPLE, OFTEN, MOST = 8_000, 3, 200_000
#: Rows of whole groups that are paired at once; pairs that are made distinct at once.
ROWS, PAIRS = 200_000, 500_000
#: Bits of the map that travels with each row, a multiple of 64, and its columns.
SMALL = 256
SMALL_MAP = [f"map{k}" for k in range(SMALL // 64)]
#: Nodes to compare whose ids are sent to all tasks; more are joined by a shuffle.
SENT = 100_000
#: Nodes that a task remembers in order to give their prefixes once.
SEEN = 1_000_000


def set_id(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def parity_map(own: np.ndarray, size: int | None = None) -> bytes:
    """A bit for each slot of a table, of n to 2n slots unless told: whether an odd number of the n shingles fall into it."""
    size = size or (max(64, 1 << (len(own) - 1).bit_length()) if len(own) else 64)
    slots = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((slots & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """The bits that differ between two maps, the larger folded to the smaller one's slots: at most as many as their sets' members do."""
    if len(x) < len(y):
        x, y = y, x
    bits, half = int.from_bytes(x, "little"), 4 * len(x)
    while half >= 8 * len(y):
        bits = (bits >> half) ^ (bits & ((1 << half) - 1))
        half //= 2
    return (bits ^ int.from_bytes(y, "little")).bit_count()


def prefix(own: np.ndarray, often: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a sorted set; ``often`` are the sorted frequent shingles."""
    if len(often):
        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
        own = own[np.lexsort((own, np.where(often[at] == own, counts[at], 0)))]
    return own[: len(own) + percent * len(own) // -100 + 1]


def frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample by text hash hold, sorted, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            own = [np.unique(shingle_hashes(t, words)) for t in b.column(0).to_pylist()]
            s, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n, pa.int64())], names=["s", "n"])

    share = max(1, -(-texts.count() // SAMPLE))
    sample = texts.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    counts = sample.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    found = counts.orderBy(F.col("n").desc(), "s").limit(MOST).toArrow()
    s, n = (found.column(c).to_numpy() for c in ("s", "n"))
    by = np.argsort(s.view(np.uint64))
    return s.view(np.uint64)[by], n[by]


def sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, own): the sorted distinct shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 128):
            own = [np.unique(shingle_hashes(t, words)) for t in b.column(0).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in own], pa.int64()), lists], names=["node", "own"])

    return texts.select("text").mapInArrow(run, "node long, own array<long>")


def prefixes(texts: DataFrame, words: int, percent: int, tables: int) -> DataFrame:
    """(doc_id, node, fps, n, prefix, map, *SMALL_MAP): node names the set and n counts it; a task has the prefix and maps of a node once, then null."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in blocks(batches):
            nodes, fps, sizes, maps, small, found, again = [], [], [], [], [], [], []
            for text in b.column(1).to_pylist():
                hashes = shingle_hashes(text, words)
                own = np.unique(hashes)
                node = set_id(own)
                nodes.append(node)
                fps.append(fingerprint(hashes, tables))
                sizes.append(len(own))
                again.append(node in seen)
                maps.append(None if again[-1] else parity_map(own))
                small.append(bytes(SMALL // 8) if again[-1] else parity_map(own, SMALL))
                found.append(np.zeros(0, np.uint64) if again[-1] else prefix(own, *sent.value, percent))
                if len(seen) < SEEN:
                    seen.add(node)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)), mask=pa.array(again, pa.bool_()))
            prints = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables), pa.array(np.array(fps, np.uint64).view(np.int64).ravel()))
            gone = np.array(again, bool)
            bits = [pa.array(c, pa.int64(), mask=gone) for c in np.frombuffer(b"".join(small), np.int64).reshape(len(small), -1).T]
            columns = [b.column(0), pa.array(nodes, pa.int64()), prints, pa.array(sizes, pa.int32()), lists, pa.array(maps, pa.binary()), *bits]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "fps", "n", "prefix", "map", *SMALL_MAP])

    return texts.mapInArrow(run, "doc_id long, node long, fps array<long>, n int, prefix array<long>, map binary, " + ", ".join(f"{c} long" for c in SMALL_MAP))


def simhash_pairs(nodes: DataFrame, budget: int) -> DataFrame:
    """Distinct pairs (src, dst) that connect nodes whose SimHashes are within ``budget`` bits, in any of the tables."""
    prints = nodes.select("node", F.posexplode("fps").alias("part", "fp"))
    leaves = settled(prints.groupBy("part", "fp").agg(F.min("node").alias("leaf")), "leaves")
    equal = prints.join(leaves, ["part", "fp"]).filter("node <> leaf").select(F.col("leaf").alias("src"), F.col("node").alias("dst"))
    near = near_links(leaves.withColumnRenamed("leaf", "node"), budget).unionByName(equal)
    return near.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def by_shingle(rows: DataFrame, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on tables of whole groups of one shingle ``s``, by node, with the end of each row's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            s = t.column("s").to_numpy()
            cut = np.concatenate([np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]])
            yield from work(t, np.repeat(cut, np.diff(cut, prepend=0)))

        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            s = t.column("s").to_numpy()
            edge = np.flatnonzero(s[1:] != s[:-1])
            if len(edge):
                yield from done(t.slice(0, edge[-1] + 1))
                held = t.slice(edge[-1] + 1).combine_chunks().to_batches()
            n = sum(h.num_rows for h in held)
        if held:
            yield from done(pa.Table.from_batches(held))

    return rows.repartition(width(rows.sparkSession), "s").sortWithinPartitions("s", "node").mapInArrow(run, schema)


def several(t: pa.Table, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of groups that have more than one node, each node once."""
    s, node = t.column("s").to_numpy(), t.column("node").to_numpy()
    own = np.concatenate([[True], (s[1:] != s[:-1]) | (node[1:] != node[:-1])])
    nodes = np.bincount(end, own, len(end) + 1)[end]
    yield from t.filter(pa.array(own & (nodes > 1))).combine_chunks().to_batches()


def pairs_of(rows: DataFrame, percent: int, ends_only: bool) -> DataFrame:
    """Distinct pairs (src, dst) of one group that may be similar and have different roots, or those with the group's first and last node.

    A group is ordered by roots, the largest first, so that nodes that are connected are
    passed over and not looked at pair by pair.
    """

    def work(t: pa.Table, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        columns = [t.column(c).to_numpy() for c in ("s", "node", "root", "n", "rest", *(() if ends_only else SMALL_MAP))]
        if not ends_only:
            s, root = columns[0], columns[2]
            by = np.lexsort((root, end))
            cut = np.flatnonzero(np.concatenate([[True], (s[by][1:] != s[by][:-1]) | (root[by][1:] != root[by][:-1])]))
            size = np.diff(np.append(cut, len(by)))
            members = np.empty(len(by), np.int64)
            members[by] = np.repeat(size, size)
            by = np.lexsort((root, -members, end))
            columns = [c[by] for c in columns]
        s, node, root = columns[:3]
        n, left = (c.astype(np.int64) for c in columns[3:5])
        bits = columns[5:]

        def add(i: np.ndarray, j: np.ndarray) -> int:
            # Where this is the first shingle that both have, they share no more than it and what is left.
            ok = (root[i] != root[j]) & ((100 + percent) * (1 + np.minimum(left[i], left[j])) >= percent * (n[i] + n[j]))
            i, j = i[ok], j[ok]
            if bits and len(i):
                ok = (100 + percent) * sum(np.bitwise_count((c[i] ^ c[j]).view(np.uint64)).astype(np.int64) for c in bits) <= (100 - percent) * (n[i] + n[j])
                i, j = i[ok], j[ok]
            held.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])))
            return len(i)

        def distinct() -> pa.RecordBatch:
            src, dst = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((dst, src))
            src, dst = src[by], dst[by]
            new = np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])[: len(src)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(src[new]), pa.array(dst[new])], names=["src", "dst"])

        at = np.arange(len(end))
        if ends_only:
            add(np.searchsorted(end, end), at)
            add(at, end - 1)
        else:
            cut = np.append(np.flatnonzero((s[1:] != s[:-1]) | (root[1:] != root[:-1])) + 1, len(s))
            other = np.repeat(cut, np.diff(cut, prepend=0))  # where the next root begins
            count = 0
            while len(at := at[end[at] > other[at]]):
                count += add(at, other[at])
                other[at] += 1
                if count >= PAIRS:
                    yield distinct()
                    count = 0
        if held:
            yield distinct()

    return by_shingle(rows, work, "src long, dst long").distinct()


def may_be_similar(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose maps leave room for the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, n, x, y = (b.column(c).to_pylist() for c in (2, 3, 4, 5))
            room = [(100 + percent) * differing(p, q) <= (100 - percent) * (i + j) for i, j, p, q in zip(m, n, x, y, strict=True)]
            yield b.select([0, 1]).filter(pa.array(room, pa.bool_()))

    side = lambda end, size, bits: nodes.select(F.col("node").alias(end), F.col("n").alias(size), F.col("map").alias(bits))
    both = pairs.join(side("src", "m", "x"), "src").join(side("dst", "n", "y"), "dst")
    return both.select("src", "dst", "m", "n", "x", "y").mapInArrow(run, "src long, dst long")


def similar(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, percent: int, label: str) -> DataFrame:
    """The pairs whose whole sets are similar; ``nodes`` has a document of each node."""
    pairs = settled(may_be_similar(pairs, nodes, percent), f"{label}-pairs")
    needed = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    needed = settled(needed.join(nodes, "node").select("node", F.col("doc_id").alias("needed")), f"{label}-nodes")
    few = needed.count() <= SENT
    wanted = F.broadcast(needed) if few else needed
    own = texts.join(wanted, texts.doc_id == F.col("needed"), "left_semi")
    # A document with two texts may give a node twice: its links are then found twice.
    own = sets(own, words).join(F.broadcast(needed.select("node")) if few else needed.select("node"), "node", "left_semi").repartition(width(texts.sparkSession), "node")
    both = pairs.join(own.select(F.col("node").alias("src"), F.col("own").alias("x")), "src").join(own.select(F.col("node").alias("dst"), F.col("own").alias("y")), "dst")
    shared = F.size(F.array_intersect("x", "y"))
    return settled(both.filter((100 + percent) * shared >= percent * (F.size("x") + F.size("y"))).select("src", "dst"), f"{label}-links")


def similar_classes(docs: DataFrame, words: int = 5, percent: int = 80, budget: int = 4, tables: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every document, as ``neardup.near_duplicates`` returns them.

    Documents are linked exactly where the Jaccard similarity of their sets of shingles is
    ``percent`` % or more (texts without words are equal); a class is all that links reach.
    ``budget`` and ``tables`` of the SimHash join move work between its step and the others.
    """
    texts = documents(docs, id_col, text_col)
    rows = settled(prefixes(texts, words, percent, tables), "prefixes")
    known = rows.filter("doc_id is not null")
    nodes = settled(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("fps").alias("fps"), F.min("n").alias("n"), F.min("map").alias("map"), *(F.min(c).alias(c) for c in SMALL_MAP)), "nodes")
    links = similar(simhash_pairs(nodes, budget), texts, nodes, words, percent, "simhash")
    place = rows.filter("doc_id is not null and prefix is not null").select("node", "n", F.posexplode("prefix").alias("at", "s"))
    place = place.select("s", "node", "n", (F.col("n") - F.col("at") - 1).alias("rest"))
    shared = settled(by_shingle(place, several, "s long, node long, n int, rest int"), "shared")
    for label in ("ends", "rest"):
        roots = settled(connected_components(links), f"{label}-roots")
        apart = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if label == "rest":
            apart = apart.join(nodes.select("node", *SMALL_MAP), "node")
        more = similar(pairs_of(apart, percent, label == "ends"), texts, nodes, words, percent, label)
        links = links.unionByName(more)
    # By the smallest documents: one that has two texts is one end of the links of both.
    named = nodes.select("node", F.col("doc_id").alias("id"))
    ends = roots.select(F.col("node").alias("src"), F.col("root").alias("dst")).unionByName(more)
    ends = ends.join(named.withColumnsRenamed({"node": "src", "id": "a"}), "src").join(named.withColumnsRenamed({"node": "dst", "id": "b"}), "dst")
    final = connected_components(ends.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("id"), "root")
    classes = named.join(final, "id", "left").select("node", F.coalesce("root", "id").alias("component_id"))
    return rows.select("doc_id", "node", F.element_at("fps", 1).alias("fp")).join(classes, "node", "left").select("doc_id", "fp", "component_id")
