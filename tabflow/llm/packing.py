"""Packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, documents, settled
from .wordtokens import word_tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
#: Pieces that are packed together, at most about.
GROUP = 1 << 17


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of whole texts: (doc_id, piece, start, length, ids_crc32, row[, ids]).

    A document's ids are those of its text and then ``end_id``; only one of more than
    ``capacity`` ids is cut, into pieces of ``capacity`` and a last shorter one.  A null
    or empty text is the one id.  ``row`` numbers rows within their task, so that
    repeated rows differ.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, row = word_tokens(tokenizer_path), 0
        for b in blocks(batches, cache="words"):
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = tokens.ids_bytes(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for column, x in zip(out, (doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), row, own), strict=True):
                        column.append(x)
                row += 1
            doc, piece, start, length, crc, rows, own = out
            arrays = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, rows))]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(own), "<u4").astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in PIECES.split(", ")] + ["ids"] * with_ids)

    return documents(docs, id_col, text_col).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int, reuse: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) for each length, and the number of bins.

    N(g) open bins have a gap of g.  Each item goes where the sum of N(g) squared gets
    smallest: into an open bin with gap g >= length, which moves one bin from g to
    g - length, or into a new one.  A bin that gets full leaves the sum.  Ties go to
    the smallest gap, and to a new bin last.  With ``reuse`` a new bin is opened only if no
    open one has room; the sum then chooses among open bins, which leaves fewer of them
    part full in the end.  Items of equal length are placed in the order given.
    """
    n = np.zeros(capacity + 1, np.int64)  # open bins by gap; n[0] stays 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for k, size in enumerate(lengths.tolist()):
        # From gap g to g - size: (n[g]-1)^2 + (n[g-size]+1)^2 less what was there.
        change = 2 * (n[: capacity + 1 - size] - n[size:] + 1)
        change[0] = 1 - 2 * n[size]  # exactly full: it leaves the sum
        open_ = n[size:] > 0
        best = -1
        if open_.any():
            cost = np.where(open_, change, never)
            best = int(cost.argmin())
        new = 2 * n[capacity - size] + 1 if size < capacity else 0
        if best >= 0 and (reuse or cost[best] <= new):
            gap = best + size
            b = stacks[gap].pop()
            n[gap] -= 1
        else:
            gap, b = capacity, len(fill)
            fill.append(0)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += size
        if gap > size:
            n[gap - size] += 1
            stacks[gap - size].append(b)
    return bins, offsets, len(fill)


def pack(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; at most ``capacity`` tokens a sequence.

    ``found`` should be settled.  Pieces are dealt by hash into groups of about
    ``GROUP``, or fewer for a small table, one task's work each; within a group they
    are placed by the sum-of-squares rule, the longest first, and no sequence is begun while
    an open one has room.  Only lengths and keys are shuffled.  A hash of all of a piece's columns deals, so repeated rows and a doc_id
    that many rows share spread as well.  Of ``found`` the columns of ``PIECES`` are read
    and all others but ``row`` are kept.
    """
    n = found.count()
    groups = max(1, -(-n // GROUP))
    group = "group"
    while group in found.columns:
        group += "_"
    found = found.withColumn(group, F.pmod(F.xxhash64("doc_id", "piece", "row", "ids_crc32"), F.lit(groups)).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy(), -lengths))
        bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        bins[order], offsets[order], _ = sum_of_squares(lengths[order], capacity, reuse=True)
        table = table.drop_columns([group, "row"])
        return table.append_column("sequence_id", pa.array((key[0].as_py() << 40) + bins)).append_column("offset", pa.array(offsets))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name not in (group, "row")]
    return found.groupBy(group).applyInArrow(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    (doc_id, piece, start, length, ids_crc32, sequence_id, offset); see ``pieces`` and
    ``pack``.  Rows with a null doc_id are packed as others; an empty table gives none.
    """
    return pack(settled(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces"), capacity)
