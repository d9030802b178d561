"""Suffix sorting by hash comparison, and byte strings that name themselves."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Odd bases of two independent hash families modulo 2**64 (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SEEDS = (1, 2)


class PrefixHashes:
    """Polynomial prefix hashes of a byte string: any substring's hash in O(1).

    Bytes are first mapped to random 64-bit values, so that few-letter texts use all
    bits; the hash of [i, j) is the difference of two prefixes, shifted to place 0.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, family: int):
        self.inverse = self._table(family, len(data) + 1)[1]
        self.sums = np.empty(len(data) + 1, U64)
        self.sums[0] = 0
        values = np.random.default_rng(SEEDS[family]).integers(0, 1 << 64, 256, U64)[data]
        values *= self._table(family, len(data) + 1)[0][: len(data)]
        np.cumsum(values, out=self.sums[1:])

    @classmethod
    def _table(cls, family: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if family not in cls._powers or len(cls._powers[family][0]) < n:
            size = max(n, 1 << 20)
            cls._powers[family] = tuple(np.cumprod(np.concatenate([[U64(1)], np.full(size, b % (1 << 64), U64)])) for b in (BASES[family], pow(BASES[family], -1, 1 << 64)))
        return cls._powers[family]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread function of 64-bit values, one to one."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    return x


def common_prefix(h: PrefixHashes, x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of suffix pairs, ``depth`` at most, by binary search over hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), depth, np.int64)
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = h.of(x, x + middle) == h.of(y, y + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def not_greater(data: np.ndarray, h: PrefixHashes, x: np.ndarray, y: np.ndarray, depth: int, strict: bool) -> np.ndarray:
    """Whether suffix x sorts before suffix y by its first ``depth`` bytes, or ties and ``strict`` is not asked."""
    n = common_prefix(h, x, y, depth)
    tie = n == depth
    at = np.minimum(n, depth - 1)
    return np.where(tie, not strict, data[x + at] < data[y + at])


def sort_suffixes(data: np.ndarray, h: PrefixHashes, suffixes: np.ndarray, blocks: np.ndarray, depth: int) -> np.ndarray:
    """The order of ``suffixes`` by (block, first ``depth`` bytes); stable.

    ``blocks`` ascends.  A bottom-up mergesort in which all merges of a level run at
    once: each suffix finds its place in the other run by binary search, each
    comparison takes O(log depth) hash comparisons.
    """
    order = np.arange(len(suffixes))
    if not len(order):
        return order
    starts = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1])
    sizes = np.diff(np.concatenate([starts, [len(blocks)]]))
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    place = np.arange(len(order)) - first
    run = 1
    while run < sizes.max():
        begin = place // (2 * run) * (2 * run)
        left = place - begin < run
        other_low = first + begin + np.where(left, run, 0)
        other_high = first + np.minimum(begin + np.where(left, 2 * run, run), size)
        active = np.flatnonzero(other_high > other_low)
        low, high = other_low[active], other_high[active]
        me, on_left = suffixes[order[active]], left[active]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            them, mine, lefts = suffixes[order[middle]], me[open_], on_left[open_]
            # From the left run: pass what is smaller; from the right run: what is not greater.
            goes = np.empty(len(open_), bool)
            goes[lefts] = not_greater(data, h, them[lefts], mine[lefts], depth, True)
            goes[~lefts] = not_greater(data, h, them[~lefts], mine[~lefts], depth, False)
            low[open_[goes]] = middle[goes] + 1
            high[open_[~goes]] = middle[~goes]
        target = np.arange(len(order))
        passed = low - other_low[active]
        own = place[active] - begin[active] - np.where(on_left, 0, run)
        target[active] = first[active] + begin[active] + own + passed
        new = np.empty_like(order)
        new[target] = order
        order = new
        run *= 2
    return order


def equal_classes(data: np.ndarray, suffixes: np.ndarray, blocks: np.ndarray, depth: int, h: PrefixHashes) -> tuple[np.ndarray, np.ndarray]:
    """(order, class number by place): suffixes of a block with equal first ``depth`` bytes share a class.

    Neighbours in sorted order that hashes call equal are compared byte by byte; a block
    with a collision is sorted again by its bytes.
    """
    order = sort_suffixes(data, h, suffixes, blocks, depth)
    s, b = suffixes[order], blocks[order]
    same = np.zeros(len(s), bool)
    pairs = np.flatnonzero(b[1:] == b[:-1])
    pairs = pairs[common_prefix(h, s[pairs], s[pairs + 1], depth) == depth]
    span = np.arange(depth)
    for lo in range(0, len(pairs), 5_000):
        p = pairs[lo : lo + 5_000]
        same[p + 1] = (data[s[p][:, None] + span] == data[s[p + 1][:, None] + span]).all(axis=1)
    for block in np.unique(b[pairs + 1][~same[pairs + 1]]):
        at = np.flatnonzero(b == block)
        text = [data[x : x + depth].tobytes() for x in s[at]]
        by = sorted(range(len(at)), key=text.__getitem__)
        order[at] = order[at][by]
        same[at] = [k > 0 and text[by[k]] == text[by[k - 1]] for k in range(len(by))]
    return order, np.cumsum(~same)
