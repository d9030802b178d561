"""Hamming self-join of 64-bit fingerprints by binary tries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, width

#: A node pair with this many leaf pairs or fewer is compared leaf by leaf.
LEAF = 16
#: Leaf pairs that one call of trie_pairs may have to look at, at worst.
AT_ONCE = 1 << 19


def trie_pairs(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of one bucket whose fingerprints differ in at most ``budget`` bits.

    ``fps`` (uint64) is sorted within each bucket [start, end).  A bucket is a binary
    trie whose nodes are index ranges.  All tries are walked at once: a frontier holds
    node pairs with the bits that differ above them; each level splits both nodes by
    the next bit and drops pairs over budget.
    """
    a0, a1 = starts.copy(), ends.copy()
    b0, b1 = starts.copy(), ends.copy()
    diff = np.zeros(len(starts), np.int64)
    found_i, found_j = [], []

    def leaves(a0, a1, b0, b1):
        na, nb = a1 - a0, b1 - b0
        n = na * nb
        at = np.repeat(np.cumsum(n) - n, n)
        k = np.arange(int(n.sum())) - at
        nb_r = np.repeat(nb, n)
        i, j = np.repeat(a0, n) + k // nb_r, np.repeat(b0, n) + k % nb_r
        ok = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
        found_i.append(i[ok])
        found_j.append(j[ok])

    for bit in range(63, -1, -1):
        keep = (a1 > a0) & (b1 > b0) & (diff <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1, diff = (x[keep] for x in (a0, a1, b0, b1, diff))
        small = (a1 - a0) * (b1 - b0) <= LEAF
        if small.any():
            leaves(a0[small], a1[small], b0[small], b1[small])
            a0, a1, b0, b1, diff = (x[~small] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        other = ~same
        a0, a1, b0, b1, diff = (
            np.concatenate(x)
            for x in (
                (a0, am, a0, am[other]),
                (am, a1, am, a1[other]),
                (b0, bm, bm, b0[other]),
                (bm, b1, b1, bm[other]),
                (diff, diff, diff + 1, diff[other] + 1),
            )
        )
    else:
        keep = (a1 > a0) & (b1 > b0) & (diff <= budget)
        leaves(a0[keep], a1[keep], b0[keep], b1[keep])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def split_mask(mask: int, parts: int) -> list[int]:
    """``mask`` with each of ``parts`` blocks of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[cut[k] : cut[k + 1]]) for k in range(parts)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, budget: int = 2, limit: int = 512) -> DataFrame:
    """Links (src, dst) that connect all fingerprints within ``budget`` differing bits.

    ``fps`` has ``part`` (int), ``fp`` (long, distinct within a part) and a node id
    ``node`` (long); parts are joined each with itself.  Two fingerprints within
    the budget agree on at least one of ``budget + 1`` blocks of bits, so the
    trie is cut into subtries by each block's value and every subtrie is joined with
    itself.  A subtrie of over ``limit`` leaves is cut again by blocks of its free
    bits, until all are smaller; no leaf is dropped.  That ends, since ``budget + 1``
    free bits or fewer tell fewer fingerprints apart than the least limit.
    Instead of all pairs in a subtrie, each of its leaves is linked to the smallest
    node of its connected part, so links number at most ``budget + 1`` times the
    fingerprints (per cut) whatever the density.
    """
    spark, parts, limit = fps.sparkSession, budget + 1, max(limit, 4 << budget)
    masks = {0}
    pending, done = fps.withColumn("mask", F.lit(0).cast("long")), []
    while True:
        children = F.create_map(*(x for m in sorted(masks) for x in (F.lit(signed(m)), F.array(*(F.lit(signed(c)) for c in split_mask(m, parts))))))
        pending = pending.withColumn("mask", F.explode(F.element_at(children, F.col("mask")))).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        masks = {c for m in masks for c in split_mask(m, parts)}
        large = settled(pending.groupBy("part", "mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("part", "mask", "key"), "large")
        if large.isEmpty():
            done.append(pending)
            break
        done.append(pending.join(large, ["part", "mask", "key"], "left_anti").select(*pending.columns))
        pending = settled(pending.join(large, ["part", "mask", "key"], "left_semi").select("part", "fp", "node", "mask"), "subtries")
    rows = reduce(DataFrame.unionByName, (d.select("part", "mask", "key", "fp", "node") for d in done))
    rows = rows.repartition(width(spark), "part", "mask", "key").sortWithinPartitions("part", "mask", "key", "fp")

    def edges(t: pa.Table) -> np.ndarray:
        """Rows after which another subtrie begins."""
        columns = (t.column(c).to_numpy() for c in ("part", "mask", "key"))
        return np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(t: pa.Table) -> Iterator[pa.RecordBatch]:
            fp, node = (t.column(c).to_numpy() for c in ("fp", "node"))
            new = edges(t) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(fp)]])
            some = ends - starts > 1
            starts, ends = starts[some], ends[some]
            work = np.cumsum((ends - starts) ** 2)
            bits = fp.view(np.uint64)
            lo = 0
            while lo < len(starts):
                hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + AT_ONCE, "right")))
                s, e = starts[lo:hi], ends[lo:hi]
                base, top = s[0], e[-1]
                # Signed longs sort below zero first: with the sign bit turned, unsigned order is the same.
                i, j = trie_pairs(bits[base:top] ^ np.uint64(1 << 63), s - base, e - base, budget)
                if len(i):
                    ids = node[base:top]
                    used = np.unique(np.concatenate([i, j]))
                    used = used[np.argsort(ids[used], kind="stable")]
                    at = np.empty(top - base, np.int64)
                    at[used] = np.arange(len(used))
                    root = used[roots(len(used), at[i], at[j])]
                    far = root != used
                    if far.any():
                        yield pa.RecordBatch.from_arrays([pa.array(ids[used][far]), pa.array(ids[root][far])], names=["src", "dst"])
                lo = hi

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < 200_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            edge = edges(t)
            if len(edge):
                yield from joined(t.slice(0, edge[-1] + 1).combine_chunks())
                held = t.slice(edge[-1] + 1).combine_chunks().to_batches()
        if held:
            yield from joined(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, "src long, dst long")
