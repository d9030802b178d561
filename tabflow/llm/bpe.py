"""Byte-level BPE encoding and decoding of whole texts.

What the pre-tokenizer leaves unsplit is encoded as a tree: leaves alone, then halves joined
level by level, the ids around each seam encoded again until both sides agree.  A piece of
``LONG`` bytes or more is cut into parts that are rows of their own: tasks encode them side by
side, and each level of joins is a shuffle of neighbouring halves.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHES, blocks, documents, settled, width

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
from tokenizers import Tokenizer  # noqa: E402

#: Chunks whose ids one worker keeps; one beyond them is encoded each time it comes.
CACHE = 500_000
#: Bytes of a leaf of the tree that a long unsplit piece becomes.
LEAF = 64
#: Bytes of a text from which its long pieces are encoded by several tasks, and of the part that one task encodes.
LONG, PART = 1 << 20, 1 << 17
#: White space among the characters that CHUNK is used on, and the pre-tokenizer's pattern (fixed values).
SPACE = r"\t-\r \x85\xa0"
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same cuts as SPLIT makes at white space: a chunk is one or more pieces.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Below these, the letters, numbers and spaces of ``regex`` are those of the library.
UNSURE = re.compile(r"[^\x00-\u052f\u2010-\u2027]")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, 256 and on for others."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBPE:
    """Encodes and decodes as the tokenizer of the file does, special tokens in a text included."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        as_bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        as_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [as_bytes.get(i, b"") for i in range(max(as_bytes) + 1)]
        self.single = [0] * 256
        for t, i in vocab.items():
            if len(t) == 1 and t in letters:
                self.single[letters[t]] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.leaf = leaf
        self.known: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of bytes that nothing splits: the lowest-ranked pair, leftmost first, until none is left."""
        ids, merges = [self.single[b] for b in data], self.merges
        while len(ids) > 1:
            found = [(m, k) for k, pair in enumerate(zip(ids, ids[1:])) if (m := merges.get(pair))]
            if not found:
                break
            (_, new), k = min(found, key=lambda x: (x[0][0], x[1]))
            a, b, out, k = ids[k], ids[k + 1], ids[:k], k
            while k < len(ids):
                if k + 1 < len(ids) and ids[k] == a and ids[k + 1] == b:
                    out.append(new)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two encoded texts' concatenation.

        A window of ids around the seam is encoded again and grows until its first
        id is the one that stood there and its last one too: then every adjacent pair
        of the result stands in an encoding, which makes the whole one.
        """
        k = 2
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            k *= 2

    def unsplit(self, data: bytes) -> list[int]:
        """The ids of one piece: leaves are encoded alone, then joined in pairs, level by level."""
        level = [self.merge(data[k : k + self.leaf]) for k in range(0, len(data), self.leaf)]
        while len(level) > 1:
            level = [self.join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0] if level else []

    def pieces(self, text: str) -> list[str] | list[bytes]:
        if not UNSURE.search(text):
            return SPLIT.findall(text)
        letters = byte_letters()
        return [bytes(letters[c] for c in p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as little-endian 32-bit bytes."""
        short = [c for c in chunks if len(c) <= self.leaf]
        ids = dict(zip(short, (e.ids for e in self.tokenizer.encode_batch_fast(short, add_special_tokens=False)), strict=True))
        for c in chunks:
            if c not in ids:
                ids[c] = [i for p in self.pieces(c) for i in self.unsplit(p.encode() if isinstance(p, str) else p)]
        return [np.asarray(ids[c], "<i4").tobytes() for c in chunks]

    def plain_bytes(self, text: str) -> bytes:
        if UNSURE.search(text):
            return np.asarray([i for p in self.pieces(text) for i in self.unsplit(p)], "<i4").tobytes()
        chunks, known = CHUNK.findall(text), self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            new = list({c for c in chunks if c not in known})
            found = dict(zip(new, self.chunk_ids(new), strict=True))
            # Long chunks are not kept: the cache is bounded in bytes, not only in entries.
            if len(known) + len(found) <= CACHE:
                known.update((c, i) for c, i in found.items() if len(c) <= self.leaf)
            return b"".join([known[c] if c in known else found[c] for c in chunks])

    def ids_bytes(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        if self.cut is None or not self.cut.search(text):
            return self.plain_bytes(text)
        return b"".join(np.asarray([self.special[p]], "<i4").tobytes() if p in self.special else self.plain_bytes(p) for p in self.cut.split(text))

    def runs(self, text: str, long: int) -> Iterator[tuple[bool, bytes]]:
        """A text as (False, ids of all up to the next long piece) and (True, a long piece's bytes), in order."""
        ready: list[bytes] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ready.append(np.asarray([self.special[part]], "<i4").tobytes())
                continue
            for piece in self.pieces(part):
                data = piece.encode() if isinstance(piece, str) else piece
                if len(data) < long:
                    ready.append(np.asarray(self.unsplit(data), "<i4").tobytes())
                    continue
                yield False, b"".join(ready)
                ready = []
                yield True, data
        yield False, b"".join(ready)

    def decode(self, ids: list[int]) -> str:
        """Special tokens are kept; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_CODERS: dict[str, ByteBPE] = {}
CACHES["chunks"] = lambda: [c.known.clear() for c in _CODERS.values()]


def coder(path: str) -> ByteBPE:
    """One for each Python worker and file."""
    if path not in _CODERS:
        _CODERS[path] = ByteBPE(path)
    return _CODERS[path]


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


PARTS = "uid long, doc_id long, piece long, part long, parts long, ids array<int>"


def far_apart(texts: DataFrame, path: str, long: int, part: int) -> DataFrame:
    """(doc_id, ids) of long texts: their long pieces' parts in tasks of their own, then joined in pairs."""
    kinds = PARTS + ", data binary"
    names = [f.split()[0] for f in kinds.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in blocks(batches, 1, cache="chunks"):  # a long text at a time
            rows = []
            for uid, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k, (open_, data) in enumerate(bpe.runs(text, long)):
                    parts = [data[at : at + part] for at in range(0, len(data), part)] if open_ else [None]
                    rows += [(uid, doc_id, k, j, len(parts), None if open_ else data, p) for j, p in enumerate(parts)]
            uid, doc, piece, at, parts, ids, data = zip(*rows, strict=True)
            ready = [np.frombuffer(i, "<i4") if i is not None else None for i in ids]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (uid, doc, piece, at, parts)), pa.array(ready, pa.list_(pa.int32())), pa.array(data, pa.binary())], names=names)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in blocks(batches, 1, cache="chunks"):
            ids = [bpe.unsplit(d) for d in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(ids, pa.list_(pa.int32()))], names=names[:6])

    def halves(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        ids = coder(path).join(rows[0]["ids"], rows[1]["ids"]) if len(rows) > 1 else rows[0]["ids"]
        first = rows[0]
        return pa.table([pa.array([x], pa.int64()) for x in (first["uid"], first["doc_id"], first["piece"], first["part"] // 2, -(-first["parts"] // 2))] + [pa.array([ids], pa.list_(pa.int32()))], names=names[:6])

    spark = texts.sparkSession
    rows = settled(texts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").repartition(width(spark), "uid").mapInArrow(cut, kinds), "parts")
    ready = rows.filter("data is null").drop("data")
    trees = settled(rows.filter("data is not null").repartition(width(spark), "uid", "piece", "part").mapInArrow(leaves, PARTS), "leaves")
    while (trees.agg(F.max("parts")).first()[0] or 1) > 1:
        trees = settled(trees.groupBy("uid", "piece", F.shiftright("part", 1).alias("pair")).applyInArrow(halves, PARTS), "halves")
    whole = ready.unionByName(trees).groupBy("uid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("runs"))
    return whole.select("doc_id", F.flatten(F.transform("runs", lambda x: x["ids"])).alias("ids"))


def by_length(docs: DataFrame, long: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The documents, and those whose texts are so long that they may have long pieces, if there are any."""
    texts, size = documents(docs, id_col, text_col), F.octet_length("text")
    if (texts.agg(F.max(size)).first()[0] or 0) < long:
        return texts, None
    return texts.filter(size < long), texts.filter(size >= long)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, part: int = PART) -> DataFrame:
    """(doc_id, ids) of every whole text.

    A null or empty text has no ids; repeated rows, and rows with a null id, return as often
    as given; an empty table gives no rows.  ``long`` and ``part`` (see ``LONG``) move work
    between tasks, not results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in blocks(batches, cache="chunks"):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([bpe.ids_bytes(t) for t in b.column(1).to_pylist()])], names=["doc_id", "ids"])

    texts, far = by_length(docs, long, id_col, text_col)
    out = texts.mapInArrow(run, "doc_id long, ids array<int>")
    return out if far is None else out.unionByName(far_apart(far, path, long, part))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every list of ids; null ids give the empty text.  Rows return as often as given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in blocks(batches, cache="chunks"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, part: int = PART) -> DataFrame:
    """(doc_id, ids, text): every whole text's ids, and what they decode to, in one pass but for long texts; see ``encode``."""

    def both(bpe: ByteBPE, doc_id: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        texts = [bpe.decode(np.frombuffer(i, "<i4").tolist()) for i in ids]
        return pa.RecordBatch.from_arrays([doc_id, _lists(ids), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in blocks(batches, cache="chunks"):
            yield both(bpe, b.column(0), [bpe.ids_bytes(t) for t in b.column(1).to_pylist()])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in blocks(batches, 1, cache="chunks"):
            yield both(bpe, b.column(0), [np.asarray(i, "<i4").tobytes() for i in b.column(1).to_pylist()])

    kinds = "doc_id long, ids array<int>, text string"
    texts, far = by_length(docs, long, id_col, text_col)
    out = texts.mapInArrow(run, kinds)
    return out if far is None else out.unionByName(far_apart(far, path, long, part).mapInArrow(back, kinds))
