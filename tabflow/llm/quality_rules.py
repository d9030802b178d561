"""Quality rules as weak supervision: votes, estimated accuracies, a posterior."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, documents, settled

SYMBOLS = "#*$%&|<>"
ASCII_SPACE = " \t\n\r\x0b\f"
UPPER = bytes(range(65, 91))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_same", "n_upper", "n_shouts"]


def measure(text: str) -> tuple[int, ...]:
    """The measures of one whole text, in the order of ``MEASURES``.

    Words are runs without ASCII white space.  word_chars: code points in words.
    n_dup_lines: lines (cut at newlines) with a word that equal an earlier line.
    n_repeat_words: words that stand in a 3-word window found twice or more.
    n_ended_lines: lines that end a sentence.  n_same: words equal to the one before.
    n_upper: A-Z.  n_shouts: exclamation marks.
    """
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    repeat = same = 0
    if n > 1:
        number: dict[bytes, int] = {}
        a = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        same = int((a[1:] == a[:-1]).sum())
        if n > 3:
            # Pairs are numbered densely first, so that a number for three words never overflows.
            pairs = np.unique(a[:-1] * len(number) + a[1:], return_inverse=True)[1]
            wins, inverse, counts = np.unique(pairs[:-1] * len(number) + a[2:], return_inverse=True, return_counts=True)
            if len(wins) < n - 2:
                twice = np.flatnonzero(counts[inverse] > 1)
                marked = np.zeros(n, bool)
                for k in range(3):
                    marked[twice + k] = True
                repeat = int(marked.sum())
    return (
        n,
        len(text) - sum(map(text.count, ASCII_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat,
        len(lines),
        sum(x.rstrip(ASCII_SPACE).endswith((".", "!", "?", ":", '"', "”", "。", "؟")) for x in lines),
        same,
        len(data) - len(data.translate(None, UPPER)),
        text.count("!"),
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *MEASURES) of every whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            rows = [measure(t) for t in b.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else ([] for _ in MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *MEASURES])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, tuple[Column, int]]:
    """Each rule's condition and the vote it then casts, 1 good or 2 bad; else it abstains.

    Rules that look for one fault vote bad alone: a text without that fault may well
    have another.  A good vote takes a text that looks like prose in several ways.
    """
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    length, symbols, shouts = per("word_chars", "n_words"), per("n_symbols", "n_words"), per("n_shouts", "n_words")
    capitals, same, ends = per("n_upper", "word_chars"), per("n_same", "n_words"), per("n_ended_lines", "n_lines")
    repeats, dup_lines = per("n_repeat_words", "n_words"), per("n_dup_lines", "n_lines")
    plain = (symbols < 0.1) & (shouts < 0.15) & (capitals < 0.2)
    varied = (repeats < 0.25) & (same < 0.1) & (dup_lines <= 0.5)
    return {
        "symbols": (symbols > 0.3, 2),
        "repeats": (repeats > 0.4, 2),
        "dup_lines": (dup_lines > 0.5, 2),
        "word_length": ((length < 2.5) | (length > 12), 2),
        "same_word": (same > 0.2, 2),
        "capitals": (capitals > 0.35, 2),
        "shouts": (shouts > 0.3, 2),
        "no_sentences": ((F.col("n_lines") > 2) & (ends < 0.05), 2),
        "prose": (plain & varied & (length > 2.5) & (length < 12), 1),
        "sentences": (plain & varied & (ends > 0.5), 1),
    }


def votes() -> Column:
    """All votes as digits of base 3, first rule lowest; 0 abstains."""
    digits = [F.when(condition, vote).otherwise(0) * 3**k for k, (condition, vote) in enumerate(rules().values())]
    return sum(digits[1:], digits[0]).cast("int")


def label_model(patterns: dict[int, int], n_rules: int, rounds: int = 100) -> dict[int, float]:
    """Posterior probability of good quality for each pattern of votes.

    Two classes; given the class, rules vote independently, each with its own chances
    to vote good, bad or abstain.  Expectation-maximisation runs over the counts of
    patterns of the whole corpus.  It starts from: one bad vote makes bad quality
    likely, a good vote without one good quality.  Chances are smoothed, and a rule's bad vote is never taken as a sign of
    good quality nor its good vote as one of bad: the classes keep their meaning.
    An abstention says nothing.
    """
    if not patterns:
        return {}
    digits = np.array([[p // 3**k % 3 for k in range(n_rules)] for p in patterns])
    count = np.array(list(patterns.values()), float)
    post = np.where((digits == 2).any(axis=1), 0.02, np.where((digits == 1).any(axis=1), 0.98, 0.7))
    for _ in range(rounds):
        weight = np.stack([count * (1 - post), count * post])  # by class: bad, good
        prior = (weight.sum(axis=1) + [1, 1]) / (count.sum() + 2)
        chance = np.stack([np.stack([weight @ (digits == v) for v in range(3)], axis=-1)])[0]  # class, rule, vote
        chance = (chance + 0.5) / (chance.sum(axis=-1, keepdims=True) + 1.5)
        ratio = np.log(chance[1]) - np.log(chance[0])  # rule, vote
        ratio[:, 0] = 0
        ratio[:, 1], ratio[:, 2] = np.maximum(ratio[:, 1], 0), np.minimum(ratio[:, 2], 0)
        score = math.log(prior[1] / prior[0]) + ratio[np.arange(n_rules), digits].sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        done, post = np.abs(new - post).max() < 1e-9, new
        if done:
            break
    return dict(zip(patterns, post.tolist(), strict=True))


def score_quality(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *MEASURES, base_failed, p_good, kept) for every document.

    ``kept`` is false where ``base_failed``, else whether the posterior of good quality
    reaches ``threshold``.  Patterns of votes are counted over all documents; they are
    at most 2 ** rules whatever the corpus, so the driver holds as many counts and
    sends back as many posteriors.  An empty table gives no rows; an empty text fails
    the base rules; repeated rows count and return as often as given.
    """
    spark = docs.sparkSession
    found = settled(measures(docs, id_col, text_col).withColumn("votes", votes()), "measures")
    patterns = {r["votes"]: r["count"] for r in found.groupBy("votes").count().collect()}
    posterior = label_model(patterns, len(rules()))
    chances = spark.createDataFrame(list(posterior.items()), "votes int, p_good double")
    out = found.join(F.broadcast(chances), "votes", "left")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).drop("votes")
