"""SimHash fingerprints of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import blocks, documents

BLOCK = 1 << 15
POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def simhashes(text: str | None, words: int = 3, tables: int = 1) -> np.ndarray:
    """64-bit SimHashes of a whole text, ``tables`` independent ones.

    A-Z are lower-cased; words are runs without ASCII white space; a shingle is
    ``words`` words joined by spaces, repeats included (a shorter text is one
    shingle, a text without words gives 0).  A bit is 1 if it is 1 in over half of
    the shingles' hashes: XXH64 (seed 42) for the first fingerprint, functions of it for
    the others.
    """
    return fingerprint(shingle_hashes(text, words), tables)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a whole text, repeats included."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    words = min(words, len(parts))
    n = len(parts) - words + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, 42) for g in map(b" ".join, zip(*(parts[k : n + k] for k in range(words))))), np.uint64, n)


def fingerprint(hashes: np.ndarray, tables: int = 1) -> np.ndarray:
    """The SimHashes of a text's shingle hashes; 0 without any."""
    ones = np.zeros((tables, 64), np.int64)
    for lo in range(0, len(hashes), BLOCK):
        first = hashes[lo : lo + BLOCK]
        for t in range(tables):
            h = first if t == 0 else mixed(first + np.uint64(t * 0x9E3779B97F4A7C15 % (1 << 64)))
            ones[t] += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return (2 * ones > len(hashes)).astype(np.uint64) @ POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread function of 64-bit values."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprints(df: DataFrame, words: int = 3, tables: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fps): the SimHashes of every whole text as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            fps = np.array([simhashes(t, words, tables) for t in b.column(1).to_pylist()], np.uint64).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables), pa.array(fps))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "fps"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, fps array<long>")
