"""Quality by the votes of nearest labelled neighbours in a latent-semantic space."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, blocks, documents, filtered, settled
from .labelled import training_documents

LOWER, UPPER, DIGIT = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")
#: Documents whose products with all neighbours are held at once.
BLOCK = 256
SHAPES = 100_000
#: Places of a cosine that count: float32 sums in another order differ behind them.
DIGITS = 5
_SHAPE: dict[str, str] = {}
CACHES["shapes"] = _SHAPE.clear


def shape(word: str) -> str:
    """A word with its runs of letters and digits folded and its other runs kept: ``Abc$$$`` is ``Aa$``."""
    s = DIGIT.sub("0", UPPER.sub("A", LOWER.sub("a", word)))
    return "~" + re.sub(r"(.)\1+", r"\1", s)


def terms(text: str) -> dict[str, float]:
    """A text's terms and their shares: words in lower case, their shapes, and words said again at once."""
    words = text.split()
    counts: Counter = Counter(words)
    out: dict[str, float] = {}
    for w, n in counts.items():
        s = _SHAPE.get(w)
        if s is None:
            s = shape(w)
            if len(_SHAPE) < SHAPES:
                _SHAPE[w] = s
        out[s] = out.get(s, 0) + n
        low = w.lower()
        out[low] = out.get(low, 0) + n
    again = sum(map(str.__eq__, words, words[1:]))
    if again:
        out["~again"] = again
    total = max(1, len(words))
    return {t: n / total for t, n in out.items()}


@dataclass
class Neighbours:
    """Term projections and the labelled vectors; float32, of bounded size."""

    index: dict[str, int]
    projection: np.ndarray  # (terms, dims), with each term's weight in it
    vectors: np.ndarray  # (labelled, dims), of length 1
    labels: np.ndarray
    k: int
    base: float

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.projection.shape[1]), np.float32)
        for row, text in zip(out, texts, strict=True):
            at, share = [], []
            for t, x in terms(text).items():
                j = self.index.get(t)
                if j is not None:
                    at.append(j)
                    share.append(x)
            if at:
                row[:] = np.sqrt(np.asarray(share, np.float32)) @ self.projection[at]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    def score(self, texts: list[str]) -> np.ndarray:
        """The similarity-weighted share of label 1 among the k nearest, by exact cosines in blocks.

        Cosines count to DIGITS places; all neighbours that are as near as the k-th vote.
        """
        out = np.full(len(texts), self.base)
        k = min(self.k, len(self.vectors))
        if not k:
            return out
        for lo in range(0, len(texts), BLOCK):
            x = self.embed(texts[lo : lo + BLOCK])
            cosine = np.round(x @ self.vectors.T, DIGITS)
            kth = np.partition(cosine, len(self.vectors) - k, axis=1)[:, -k, None]
            weight = np.where(cosine >= kth, np.maximum(cosine, 0), 0) ** 4
            total = weight.sum(axis=1, dtype=np.float64)
            share = weight @ self.labels
            some = total > 0
            out[lo : lo + BLOCK][some] = share[some] / total[some]
        return np.clip(out, 0, 1)


def decomposed(ends: np.ndarray, at: np.ndarray, share: np.ndarray, idf: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``dims`` right singular vectors of the documents' weighed terms, and the documents in them, of length 1.

    Document i has the terms at[ends[i]:ends[i + 1]]; rows of the matrix are made BLOCK at a time.
    """

    def unit(x: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, length, out=x, where=length > 0)

    def weighed() -> Iterator[tuple[slice, np.ndarray]]:
        for lo in range(0, len(ends) - 1, BLOCK):
            own = ends[lo : lo + BLOCK + 1]
            x = np.zeros((len(own) - 1, len(idf)), np.float32)
            x[np.repeat(np.arange(len(x)), np.diff(own)), at[own[0] : own[-1]]] = share[own[0] : own[-1]]
            x *= idf
            yield slice(lo, lo + len(x)), unit(x)

    gram = np.zeros((len(idf), len(idf)), np.float32)
    for _, x in weighed():
        gram += x.T @ x
    basis = np.linalg.eigh(gram)[1][:, ::-1][:, :dims].astype(np.float32)
    vectors = np.empty((len(ends) - 1, dims), np.float32)
    for place, x in weighed():
        vectors[place] = unit(x @ basis)
    return basis, vectors


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", bound: int = 8_000, n_terms: int = 2_048, dims: int = 48, k: int = 15, id_col: str = "doc_id", text_col: str = "text") -> Neighbours:
    """Fits latent-semantic vectors on at most ``bound`` labelled documents, in hash order.

    Labels of held-out ids are never read.  The ``n_terms`` terms that stand in most of
    the sample's documents are weighed by inverse document frequency and reduced to
    ``dims`` dimensions by an exact singular value decomposition.  The driver holds the
    terms that the documents have; a task makes their bound x n_terms matrix in blocks
    and decomposes n_terms x n_terms float32.  Without labelled rows all
    scores are 1.
    """
    sample = settled(training_documents(docs, labels, label_col, bound, False, id_col, text_col), "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for t in b.column(0).to_pylist():
                counts.update(terms(t).keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    n = sample.count()
    frequent = sample.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2, n // 1000))
    vocabulary = [(r["term"], r["n"]) for r in frequent.orderBy(F.col("n").desc(), "term").limit(n_terms).collect()]
    index = {t: j for j, (t, _) in enumerate(vocabulary)}
    idf = np.log((n + 1) / (np.array([c for _, c in vocabulary], np.float64) + 0.5)).astype(np.float32) + 0.1
    if not n or not vocabulary:
        return Neighbours({}, np.zeros((0, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), k, 1.0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [{index[t]: x for t, x in terms(text).items() if t in index} for text in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float32())), b.column(1)], names=["at", "share", "label"])

    rows = sample.orderBy("doc_id").select("text", "label").mapInArrow(weigh, "at array<int>, share array<float>, label int").toArrow().combine_chunks()
    at, share = rows.column("at").combine_chunks(), rows.column("share").combine_chunks()
    dims = min(dims, len(vocabulary))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((at.offsets.to_numpy(), at.values.to_numpy(), np.sqrt(share.values.to_numpy()), idf))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            basis, vectors = decomposed(*sent.value, dims)
            yield pa.RecordBatch.from_arrays([pa.array([basis.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["basis", "vectors"])

    fitted = spark.range(0, 1, 1, 1).mapInArrow(fit, "basis binary, vectors binary").collect()[0]
    sent.unpersist()
    basis, vectors = (np.frombuffer(fitted[c], np.float32).reshape(-1, dims) for c in ("basis", "vectors"))
    y = rows.column("label").to_numpy().astype(np.float64)
    return Neighbours(index, basis * idf[:, None], vectors, y, k, float(y.mean()))


def score(docs: DataFrame, model: Neighbours, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; one without known terms scores the sample's mean label."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in blocks(batches, cache="shapes"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.score(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def accept(docs: DataFrame, model: Neighbours, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score ``threshold`` or more, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, text_col, lambda texts: (sent.value.score(texts) >= threshold).tolist(), "shapes")
