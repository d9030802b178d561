"""Near copies by shingles against brute force over all pairs."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from tabflow.llm import neardup, similar

SF_DIR = "/root/testdata/sf0.01"


def shingles(text, words=5):
    parts = (text or "").encode().lower().split()
    if not parts:
        return frozenset()
    words = min(words, len(parts))
    return frozenset(tuple(parts[k : k + words]) for k in range(len(parts) - words + 1))


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def classes(rows):
    """The smallest id that links of 0.8 or more reach, by all pairs."""
    own = [(i, shingles(t)) for i, t in sorted(rows)]
    root = {i: i for i, _ in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def edited(rng, text, n):
    """``text`` with n words replaced, far from each other."""
    text = list(text)
    for k in rng.sample(range(2, len(text) - 2, 5), n):
        text[k] = f"new{rng.randrange(10**9)}"
    return text


def found(spark, rows):
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 4, 16).collect()
    assert len(got) == len(rows)
    return {r.doc_id: r.component_id for r in got}


def test_every_pair_from_080_is_found(spark):
    """Pairs of 0.80 to 0.90: SimHashes within few bits find about half of them."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    rows, pairs = [], 0
    for k in range(60):
        text = rng.choices(words, k=204)
        other = edited(rng, text, 2 + k % 3)
        pairs += 0.8 <= likeness(shingles(" ".join(text)), shingles(" ".join(other))) < 0.96
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    assert pairs == 60
    assert found(spark, rows) == {i: i // 2 * 2 for i, _ in rows}


@pytest.mark.parametrize("often", [3, 10**9])
def test_all_pairs_of_a_table(spark, monkeypatch, often):
    """Common lines, a large class, chains, short and empty texts; with and without frequent shingles."""
    monkeypatch.setattr(similar, "OFTEN", often)
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    line, base = rng.choices(words, k=20), rng.choices(words, k=150)
    rows = [" ".join(line + rng.choices(words, k=rng.randint(5, 60))) for _ in range(80)]
    rows += [" ".join(edited(rng, base, rng.randint(0, 5))) for _ in range(80)]
    for _ in range(40):
        text = rng.choices(words, k=rng.randint(30, 300))
        for _ in range(4):
            rows.append(" ".join(text))
            text = edited(rng, text, max(1, len(text) // 60))
    rows += ["", " ", None, "a", "A", "a b c", "a b c d", "word " * 40, "word " * 60]
    rows = list(enumerate(rng.sample(rows, len(rows))))
    assert found(spark, rows) == classes(rows)


def test_family_around_the_limit(spark):
    """Several hundred variants of one text, most pairs near 0.8: no pair over it may be lost, by maps or else."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    base = rng.choices(words, k=140)
    rows = [(k, " ".join(edited(rng, base, rng.randint(2, 5)))) for k in range(400)]
    rows += [(1000 + k, " ".join(base[k : k + 100] + rng.choices(words, k=rng.randint(8, 30)))) for k in range(40)]
    expected = classes(rows)
    assert 5 < len(set(expected.values())) < 400
    assert found(spark, rows) == expected


def test_maps_never_differ_more_than_sets():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, 64, 65, 300, 1000):
        for share in (0.0, 0.3, 0.8, 1.0):
            own = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            other = np.unique(np.concatenate([own[: int(share * n)], rng.integers(0, 1 << 64, rng.integers(0, n + 1), np.uint64)]))
            apart = len(np.setxor1d(own, other))
            assert similar.differing(similar.parity_map(own), similar.parity_map(other)) <= apart
            small = [np.frombuffer(similar.parity_map(x, similar.SMALL), np.uint64) for x in (own, other)]
            assert int(np.bitwise_count(small[0] ^ small[1]).sum()) <= apart


def test_all_pairs_of_sf001(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    assert found(spark, rows) == classes(rows)


def test_no_text_under_080_goes(spark):
    """Pairs of 0.70 to 0.79 stay two documents, and what goes has a partner of 0.8 or more."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    rows = []
    for k in range(100):
        text = rng.choices(words, k=204)
        other = edited(rng, text, 5 + k % 3)
        assert 0.7 <= likeness(shingles(" ".join(text)), shingles(" ".join(other))) < 0.8
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    rows += [(1000 + i, t + " end") for i, t in rows[:20]]
    kept = neardup.representatives(spark.createDataFrame(rows, "doc_id long, text string"), words=5, budget=4, tables=16)
    assert {r.doc_id for r in kept.collect()} == set(range(200))
