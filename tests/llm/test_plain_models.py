"""Models against plain versions of the same estimates."""

from __future__ import annotations

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import plain

from tabflow.llm import neighbours, quality_rules, toxicity

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()], labels.collect()


def test_quality_of_every_document(tables):
    """Own terms, decomposition and neighbours for all rows, ties within rounding allowed for."""
    docs, labels, rows, marks = tables
    own = plain.Quality(rows, {r.doc_id: r.quality for r in marks})
    got = {r.doc_id: r.score for r in neighbours.score(docs, neighbours.train(docs, labels)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        low, high = own.bounds(t)
        assert low - 2e-3 <= got[i] <= high + 2e-3


def test_equally_near_neighbours_all_vote():
    model = neighbours.Neighbours({"a": 0, "b": 1}, np.eye(2, dtype=np.float32), np.array([[1, 0]] * 4 + [[0, 1]], np.float32), np.array([1, 1, 0, 0, 0.0]), 2, 0.3)
    assert model.score(["a", "b", "", "zzz"]).tolist() == [0.5, 0.0, 0.3, 0.3]
    turned = neighbours.Neighbours(model.index, model.projection, model.vectors[::-1].copy(), model.labels[::-1].copy(), 2, 0.3)
    assert turned.score(["a", "b", "", "zzz"]).tolist() == [0.5, 0.0, 0.3, 0.3]


def test_long_words_are_terms():
    assert neighbours.terms("Subscribe newsletter123$$$$newsletter123") == plain.terms("Subscribe newsletter123$$$$newsletter123")
    assert "subscribe" in neighbours.terms("Subscribe now")


def test_toxicity_of_every_document(tables):
    docs, labels, rows, _ = tables
    model = toxicity.train(docs, labels)
    assert model.lexicon
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(plain.toxic_score(model, t), abs=1e-9)


@pytest.mark.parametrize("trust", [0.0, 1.0])
def test_toxic_label_model(trust):
    rng = random.Random(5)
    rows, lexicon = [], 5
    for _ in range(60):
        bad = rng.random() < 0.4
        v = [int(rng.random() < (0.6 if bad else 0.1)) for _ in range(4)]
        rows.append([*v, v[0], int(sum(v) > 1), int(not any(v))])
    seen = np.array([[0.1, 0.1, 0.1, 0.1, 0.1, 0.2, 0.6], [0.6, 0.6, 0.6, 0.6, 0.6, 0.8, 0.1]])
    for rounds in (1, 4):
        got = toxicity.label_model(np.array(rows, np.int8), seen, lexicon, 0.3, trust, rounds)
        assert got == pytest.approx(plain.toxic_posteriors(rows, seen.tolist(), lexicon, 0.3, trust, rounds), abs=1e-8)


def test_linear_classifier_is_at_its_optimum():
    """The penalised likelihood has no slope at the weights found, and is lower a step away."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2, (80, 6)).astype(np.int8)
    target = np.clip(0.1 + 0.5 * x[:, 0] + 0.3 * x[:, 1] * rng.random(80), 0, 1)
    weight = rng.random(80) + 0.1
    w, bias = toxicity.linear(x, target, weight)

    def loss(w, bias):
        z = x @ w + bias
        ridge = np.full(6, 1e-3 * weight.sum())
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 0.5 * (ridge * w * w).sum() + 0.5e-6 * bias * bias)

    best = loss(w, bias)
    for j in range(6):
        for step in (-1e-3, 1e-3):
            assert loss(w + step * np.eye(6)[j], bias) > best
    assert loss(w, bias + 1e-3) > best < loss(w, bias - 1e-3)


def test_quality_label_model():
    rng = random.Random(7)
    rows = []
    for _ in range(200):
        good = rng.random() < 0.6
        rows.append([rng.choice([0, 1, 1] if good else [0, 0, 1]), *(rng.choice([0, 0, 0, 2] if good else [0, 2, 2]) for _ in range(4))])
    patterns = Counter(sum(v * 3**k for k, v in enumerate(r)) for r in rows)
    for rounds in (1, 7):
        got = quality_rules.label_model(dict(patterns), 5, rounds)
        for r, p in zip(rows, plain.quality_posteriors(rows, rounds), strict=True):
            assert got[sum(v * 3**k for k, v in enumerate(r))] == pytest.approx(p, abs=1e-8)


def test_kept_follows_the_plain_posterior(tables):
    docs, *_ = tables
    rows = quality_rules.score_quality(docs).collect()
    names = list(quality_rules.rules())
    measured = [{m: r[m] for m in quality_rules.MEASURES} for r in rows]

    def votes(m):
        per = lambda a, b: m[a] / max(m[b], 1)
        length, symbols, shouts = per("word_chars", "n_words"), per("n_symbols", "n_words"), per("n_shouts", "n_words")
        capitals, same, ends = per("n_upper", "word_chars"), per("n_same", "n_words"), per("n_ended_lines", "n_lines")
        repeats, lines = per("n_repeat_words", "n_words"), per("n_dup_lines", "n_lines")
        prose = symbols < 0.1 and shouts < 0.15 and capitals < 0.2 and repeats < 0.25 and same < 0.1 and lines <= 0.5
        bad = [symbols > 0.3, repeats > 0.4, lines > 0.5, length < 2.5 or length > 12, same > 0.2, capitals > 0.35, shouts > 0.3, m["n_lines"] > 2 and ends < 0.05]
        return [*(2 * b for b in bad), int(prose and 2.5 < length < 12), int(prose and ends > 0.5)]

    own = [votes(m) for m in measured]
    assert len(names) == len(own[0])
    for r, p in zip(rows, plain.quality_posteriors(own, 100), strict=True):
        assert r.p_good == pytest.approx(p, abs=1e-6)
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)
