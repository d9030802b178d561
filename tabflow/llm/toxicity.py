"""Toxicity by weak supervision: many voters, a label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, documents, filtered, settled
from .labelled import held_out, training_documents

WORD = re.compile(r"[^\W\d_]+")
PREFIX = range(3, 9)
#: Shares of a text's words that hit the lexicon; each is a pattern voter.
RATES = (0.002, 0.005, 0.01, 0.02, 0.05)


def shapes(word: str) -> list[str]:
    """The lexicon entries that a word may match: itself and its beginnings."""
    return [word + "$", *(word[:k] + "*" for k in PREFIX if len(word) > k)]


def entries(text: str) -> set[str]:
    return {e for w in set(WORD.findall(text.lower())) for e in shapes(w)}


@dataclass
class ToxicityModel:
    """A lexicon of voters and the weights of a linear classifier over their votes."""

    lexicon: dict[str, int]
    weights: np.ndarray
    bias: float

    @property
    def n_votes(self) -> int:
        return len(self.lexicon) + len(RATES) + 2

    def votes(self, text: str) -> list[int]:
        """Indexes of the voters that fire: entries met and rates reached, or else too few hits for its length, or none."""
        lexicon, met, hits, n = self.lexicon, set(), 0, 0
        for word, times in Counter(WORD.findall(text.lower())).items():
            n += times
            found = [j for e in shapes(word) if (j := lexicon.get(e)) is not None]
            if found:
                met.update(found)
                hits += times
        if not hits:
            return [self.n_votes - 1]
        rates = [len(lexicon) + k for k, r in enumerate(RATES) if hits >= r * n]
        return sorted(met) + (rates or [self.n_votes - 2])

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[self.votes(text)].sum())
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def candidates(sample: DataFrame, n: dict[int, int], size: int, surprise: float) -> list[str]:
    """The ``size`` entries that go with label 1 most clearly.

    Entries (words and beginnings of words) are counted once a document, by label,
    partly in the tasks and then by entry.  One is eligible if its documents' labels
    are, under the sample's share of label 1, less likely by e ** ``surprise``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by[1 if label else 0].update(entries(text))
            names = list(by[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[e] for e in names], pa.int64()) for c in (by[1], by[0]))], names=["entry", "pos", "neg"])
            names = [e for e in by[0] if e not in by[1]]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.zeros(len(names), np.int64)), pa.array([by[0][e] for e in names], pa.int64())], names=["entry", "pos", "neg"])

    share = n[1] / (n[1] + n.get(0, 0))
    counts = sample.select("text", "label").mapInArrow(run, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    both = F.col("pos") + F.col("neg")
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * max(p, 1e-6)))).otherwise(0.0)
    odd = counts.withColumn("odd", part("pos", share) + part("neg", 1 - share)).filter((F.col("odd") >= surprise) & (F.col("pos") > share * both))
    return [r["entry"] for r in odd.orderBy(F.col("odd").desc(), "entry").limit(size).select("entry").collect()]


def cover(names: list[str], met: list[list[int]], labels: np.ndarray, n: dict[int, int], size: int, lift: float, times: int = 5) -> list[int]:
    """Entries that, one after another, meet most texts of label 1 that are not yet met ``times`` times.

    An entry must meet enough such texts for log odds of ``lift`` on them alone.  Texts
    that a taken entry has met no longer count for its own beginnings and endings: what
    is frequent only for the sake of a word already taken is left out.
    """
    split: dict[int, tuple[set[int], set[int]]] = {}
    for row, entries_met in enumerate(met):
        for e in entries_met:
            split.setdefault(e, (set(), set()))[0 if labels[row] else 1].add(row)
    stems, again, taken = [x[:-1] for x in names], Counter(), []
    while len(taken) < size:
        best, gain = None, 0.0
        for e, (pos, neg) in split.items():
            odds = math.log((len(pos) + 0.5) / (n[1] + 1)) - math.log((len(neg) + 0.5) / (n.get(0, 0) + 1))
            if len(pos) >= 3 and odds >= lift and (len(pos) - 3 * len(neg), -e) > (gain, -(best if best is not None else e)):
                best, gain = e, len(pos) - 3 * len(neg)
        if best is None:
            return taken
        taken.append(best)
        pos, neg = split.pop(best)
        again.update(pos)
        full = {r for r in pos if again[r] >= times}
        for e, (p, q) in split.items():
            kin = stems[e].startswith(stems[best]) or stems[best].startswith(stems[e])
            p -= pos if kin else full
            if kin:
                q -= neg
    return taken


def label_model(votes: np.ndarray, seen: np.ndarray, lexicon: int, prior: float = 0.5, trust: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Posterior of label 1 for each row of a 0/1 matrix of votes.

    ``seen`` has the chances (label, voter) counted on training labels: the prior of the
    estimates, which weighs ``trust`` times as much as the rows.  Without it, one chance
    hit would draw clean texts into the toxic class round by round.

    Given the class, voter j fires with its own chance.  Voters that agree within a
    class beyond chance are correlated: a vote's log odds are divided by one plus the
    sum of its absolute correlations with the other voters that fire on the row, so
    that a word and its many beginnings count about once.  Chances, correlations and
    posteriors are estimated in turns (expectation-maximisation).
    """
    v = votes.astype(np.float64)
    post = np.where(votes[:, :lexicon].sum(axis=1) >= 2, 0.9, np.where(votes[:, :lexicon].any(axis=1), 0.5, 0.02))
    belief = trust * len(votes) / 2
    for _ in range(rounds):
        weight = np.stack([1 - post, post])
        chance = (weight @ v + belief * seen + 0.25) / (weight.sum(axis=1, keepdims=True) + belief + 0.5)
        share = 0.5 * post.mean() + 0.5 * prior
        ratio = np.log(chance[1] / chance[0])
        ratio[:lexicon] = np.maximum(ratio[:lexicon], 0)
        correlation = np.zeros((v.shape[1], v.shape[1]))
        for w, c in zip(weight, chance, strict=True):
            d = (v - c) * np.sqrt(w / max(w.sum(), 1e-9))[:, None]
            cov = d.T @ d
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            correlation = np.maximum(correlation, np.abs(cov / np.outer(sd, sd)))
        np.fill_diagonal(correlation, 0)
        correlation[correlation < 0.2] = 0
        score = math.log(share / (1 - share)) + (v * ratio / (1 + v @ correlation)).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        done, post = np.abs(new - post).max() < 1e-6, new
        if done:
            break
    return post


def linear(votes: np.ndarray, target: np.ndarray, weight: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels, by Newton's steps."""
    x = np.hstack([votes.astype(np.float64), np.ones((len(votes), 1))])
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2 * weight.sum())
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (target - p)) - ridge * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", bound: int = 12_000, size: int = 128, surprise: float = 13.0, lift: float = 3.0, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fits a model on at most ``bound`` labelled documents, at most half of each label.

    Labels of held-out ids are never read.  Labels serve to find the lexicon, as the
    label model's prior and to weigh the two halves as in the whole training set; the
    classifier is fitted on the label model's posteriors.  Without rows of label 1, every score is the same low one.
    """
    sample = settled(training_documents(docs, labels, label_col, bound, True, id_col, text_col), "toxic-sample")
    truth = {r["y"]: r["count"] for r in labels.filter(~held_out(id_col)).groupBy(F.col(label_col).cast("int").alias("y")).count().collect()}
    taken = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    prior = min(0.9, max(0.001, truth.get(1, 0) / max(1, truth.get(0, 0) + truth.get(1, 0))))
    silent = ToxicityModel({}, np.zeros(len(RATES) + 2), math.log(prior / (1 - prior)))
    found = candidates(sample, taken, 8 * size, surprise) if taken.get(1) else []
    if not found:
        return silent
    wide = {e: j for j, e in enumerate(found)}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(wide[e] for e in entries(t) if e in wide) for t in b.column(0).to_pylist()], pa.list_(pa.int32())), b.column(1)], names=["met", "label"])

    known = sample.select("text", "label").mapInArrow(meet, "met array<int>, label int").filter(F.size("met") > 0).collect()  # of the bounded sample
    lexicon = [found[e] for e in cover(found, [r["met"] for r in known], np.array([r["label"] for r in known]), taken, size, lift)]
    if not lexicon:
        return silent
    model = ToxicityModel({e: j for j, e in enumerate(lexicon)}, np.zeros(len(lexicon) + len(RATES) + 2), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.votes(t) for t in b.column(0).to_pylist()], pa.list_(pa.int32())), b.column(1)], names=["votes", "label"])

    rows = sample.select("text", "label").mapInArrow(run, "votes array<int>, label int").groupBy("votes", "label").count().collect()
    votes = np.zeros((len(rows), model.n_votes), np.int8)
    weight = np.empty(len(rows))
    for k, r in enumerate(rows):
        votes[k, r["votes"]] = 1
        weight[k] = r["count"] * (prior / taken[1] if r["label"] else (1 - prior) / max(1, taken.get(0, 0)))
    times = np.array([r["count"] for r in rows])
    by_label = np.stack([times * np.array([r["label"] == y for r in rows]) for y in (0, 1)]).astype(np.float64)
    seen = (by_label @ votes + 0.5) / (by_label.sum(axis=1, keepdims=True) + 1)
    posterior = label_model(np.repeat(votes, times, axis=0), seen, len(lexicon))
    first = np.cumsum([0, *times[:-1]])
    model.weights, model.bias = linear(votes, posterior[first], weight * len(rows))
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; a null or empty text scores as one that meets no entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def accept(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score under ``threshold``, all columns as they are."""
    return filtered(docs, text_col, lambda texts: [model.score(t) < threshold for t in texts])
