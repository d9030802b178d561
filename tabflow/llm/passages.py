"""Removal of repeated passages, exactly, by sorted suffixes of anchored contexts.

A passage is any string of ``length`` bytes; each of its bytes is removed wherever the
string also starts earlier (smaller document, or same document, earlier start).

Sorting every suffix of a large corpus would move many times its size.  Instead each
window of ``length`` bytes has an *anchor*: the substring of ``GRAM`` bytes in it with
the smallest hash, leftmost first.  Equal windows have equal anchors at equal places, so
only windows with the same anchor string need to meet.

1. Consecutive windows with one anchor form a *segment*.  A task hashes its texts and
   emits one row for each segment: (anchor hash, segment hash, place).  Rows of segments
   in one task whose hashes and bytes are equal are folded to the first, the others are
   repeats at once; so no segment has more rows than there are folds, however many copies
   it has.
2. By anchor hash: of segments with equal hashes all but the first are *claimed* to repeat
   the first.  Where one anchor has several different segments, the first of each is asked
   for its bytes.  One row is held at a time.  Anchors that a sample of documents shows in
   many different segments are dealt by segment hash as well: their segments are all asked
   for, so they need not meet here.  The sample only moves work.
3. Claims of one document on another that follow each other become one range.  The bytes of
   asked segments and of ranges that are claimed are cut from the texts.
4. By anchor: all windows of asked segments, as suffixes of the joined bytes, are sorted by
   ``suffixes.equal_classes``; in each class all but the first are repeats.  An anchor
   with over ``LIMIT`` different segments goes window by window instead, by the window's
   hash, equal ones folded in the task first.
5. Each document compares the bytes of its claims with its own, and what holds and what 4
   found is united and cut from its text.  Should a claim fail, two different segments have
   one hash: their anchors' hashes are not trusted, all their segments are asked for, and
   the work is done again from 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, blocks, documents, drop_settled, for_each_row, settled, width, with_row_ids
from .suffixes import U64, PrefixHashes, equal_classes, mixed

CACHES["powers"] = PrefixHashes._powers.clear
GRAM = 36
#: Bytes that are hashed together; segments, and bytes, that a task folds together; segments whose places are Python numbers at a time.
SLICE = 1 << 19
FOLD, FOLD_BYTES, COMPARED = 400_000, 1 << 24, 20_000
#: Segments of one anchor that are sorted in one task.
LIMIT = 1000
#: Windows that are sorted together, about.
SORT = 200_000
#: Documents in the sample that shows hot anchors, about; different segments there that make one hot; how many such are kept.
SAMPLE, HOT, MOST = 4_000, 8, 200_000
#: What is added to the windows of a hot anchor's segment on its way.
HOT_FLAG = 1 << 40
#: Claims on one document that are served together; more are dealt to several rows.
SERVED = 4_096

SEGMENTS = "k long, sh long, rid long, start long, n long"
MARKS = "rid long, start long, stop long, k long, rid0 long, start0 long"
FOUND = "rid long, start long, stop long, bytes binary"


def merged(rid: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of ranges for each rid: those that overlap or touch become one."""
    if not len(rid):
        return rid, start, stop
    order = np.lexsort((start, rid))
    rid, start, stop = rid[order], start[order], stop[order]
    # A running maximum that begins anew with each rid: later rids are lifted above all earlier stops.
    step = np.cumsum(np.concatenate([[0], rid[1:] != rid[:-1]])) * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + step)
    new = np.concatenate([[True], start[1:] + step[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:] - 1, [len(rid) - 1]])
    return rid[at], start[at], reach[last] - step[last]


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, text number, first window, windows) of joined texts' segments.

    Text t is data[offsets[t]:offsets[t + 1]]; first windows are places in ``data``.
    """
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = PrefixHashes(data, 0)
    m = n - GRAM + 1
    grams = (h.sums[GRAM:] - h.sums[:m]) * h.inverse[:m]
    bits = U64((1 << max(24, n.bit_length())) - 1)
    least = (mixed(grams) & ~bits) | np.arange(m, dtype=U64)
    wide, seen = length - GRAM + 1, 1
    while seen * 2 <= wide:
        least = np.minimum(least[:-seen], least[seen:])
        seen *= 2
    if seen < wide:
        least = np.minimum(least[: len(least) - (wide - seen)], least[wide - seen :])
    inside = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: n - length + 1])
    if not len(windows):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    anchor = (least[windows] & bits).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    first, count = windows[cut], np.diff(np.concatenate([cut, [len(windows)]]))
    whole = PrefixHashes(data, 1).of(first, first + count - 1 + length)
    sh = mixed(whole + count.astype(U64) * U64(0x9FB21C651E98DF25)).view(np.int64)
    return grams[anchor[cut]].view(np.int64), sh, np.searchsorted(offsets, first, "right") - 1, first, count


def _texts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined texts of about SLICE bytes: (data, offsets, rid, start in the document) by slice of a text."""
    parts: list[bytes] = []
    rids: list[int] = []
    bases: list[int] = []
    held = 0

    def joined():
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.array(rids, np.int64), np.array(bases, np.int64)

    for b in blocks(batches, cache="powers"):
        for rid, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            for base in range(0, max(1, len(text) - length + 1), SLICE):
                part = text[base : base + SLICE + length - 1]
                parts.append(part)
                rids.append(rid)
                bases.append(base)
                held += len(part)
                if held >= SLICE:
                    yield joined()
                    parts, rids, bases, held = [], [], [], 0
    if parts:
        yield joined()


def _folded(found: list[tuple[np.ndarray, ...]], data: list[np.ndarray], length: int) -> pa.RecordBatch:
    """One batch of SEGMENTS: first rows of equal segments, and the others' ranges with n = -1 and the stop in sh.

    ``found`` has k, sh, rid, start, n, the place in the joined ``data`` and the flag of each segment.
    """
    k, sh, rid, start, n, at, flag = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, rid, n, sh, k))
    k, sh, rid, start, n, at, flag = (x[order] for x in (k, sh, rid, start, n, at, flag))
    again = np.concatenate([[False], (k[1:] == k[:-1]) & (sh[1:] == sh[:-1]) & (n[1:] == n[:-1])])
    rows, joined = np.flatnonzero(again), b"".join(data)
    for lo in range(0, len(rows), COMPARED):
        own = rows[lo : lo + COMPARED]
        x, y, z = at[own].tolist(), at[own - 1].tolist(), (n[own] - 1 + length).tolist()
        again[own] = [joined[p : p + m] == joined[q : q + m] for p, q, m in zip(x, y, z, strict=True)]
    r, a, z = merged(rid[again], start[again], (start + n - 1 + length)[again])
    key = mixed((r * 1_000_003 + a).astype(np.int64).view(U64)).view(np.int64)
    own = ~again
    columns = (np.concatenate(x) for x in ((k[own], key), (sh[own], z), (rid[own], r), (start[own], a), (n[own] + flag[own], np.full(len(r), -1))))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k", "sh", "rid", "start", "n"])


def hot_anchors(texts: DataFrame, length: int) -> np.ndarray:
    """Hashes of anchors with HOT or more different segments in a sample of documents, sorted; at most MOST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, _, _ in _texts(batches, length):
            k, sh = np.unique(np.stack(segments(data, offsets, length)[:2]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(sh, pa.int64())], names=["k", "sh"])

    share = max(1, -(-texts.count() // SAMPLE))
    sample = texts.filter(F.pmod(F.xxhash64("rid"), F.lit(share)) == 0).mapInArrow(run, "k long, sh long")
    counts = sample.distinct().groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= HOT)
    return np.sort(counts.orderBy(F.col("c").desc(), "k").limit(MOST).select("k").toArrow().column(0).to_numpy())


def segment_rows(texts: DataFrame, length: int, hot: np.ndarray, hash_bits: int = 64) -> DataFrame:
    """SEGMENTS of the texts, folded by task; n has HOT_FLAG where the anchor is one of ``hot``."""
    kept_bits = np.int64(-1) if hash_bits >= 64 else np.int64((1 << hash_bits) - 1)
    sent = texts.sparkSession.sparkContext.broadcast(hot)  # at most MOST numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, joined, held, size = [], [], 0, 0
        for data, offsets, rid, base in _texts(batches, length):
            k, sh, t, first, n = segments(data, offsets, length)
            if not len(k):
                continue
            at = np.minimum(np.searchsorted(sent.value, k), len(sent.value) - 1)
            flag = np.where(sent.value[at] == k, HOT_FLAG, 0) if len(sent.value) else np.zeros(len(k), np.int64)
            found.append((k, sh & kept_bits, rid[t], base[t] + first - offsets[t], n, size + first, flag))
            joined.append(data)
            held += len(k)
            size += len(data)
            if held >= FOLD or size >= FOLD_BYTES:
                yield _folded(found, joined, length)
                found, joined, held, size = [], [], 0, 0
        if held:
            yield _folded(found, joined, length)

    return texts.mapInArrow(run, SEGMENTS)


def first_segments(rows: DataFrame, length: int, distrusted: np.ndarray) -> DataFrame:
    """MARKS of three kinds.

    Repeats (stop > 0), claims to repeat the segment that starts at rid0, start0 (stop > 0
    too), and segments whose bytes are asked for (stop = minus their windows).  Segments of
    ``distrusted`` anchors claim nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, ...] | None = None  # the last row that began a segment: k, sh, rid, start, n, asked
        for b in batches:
            if not b.num_rows:
                continue
            k, sh, rid, start, n = (c.to_numpy() for c in b.columns)
            ready = n < 0
            out = [(rid[ready], start[ready], sh[ready], k[ready], rid[ready], start[ready])]
            k, sh, rid, start, n = (x[~ready] for x in (k, sh, rid, start, n))
            hot = n >= HOT_FLAG
            n = n & (HOT_FLAG - 1)
            claimed = 0
            if len(k):
                if last:
                    hot = np.concatenate([[False], hot])  # it has been asked for already
                    k, sh, rid, start, n = (np.concatenate([[x], y]) for x, y in zip(last[:5], (k, sh, rid, start, n), strict=True))
                again = np.concatenate([[False], (k[1:] == k[:-1]) & (sh[1:] == sh[:-1]) & (n[1:] == n[:-1])])
                if len(distrusted):
                    again &= ~np.isin(k, distrusted)
                at = np.flatnonzero(~again)
                first = at[np.cumsum(~again) - 1][again]
                claimed = len(first)
                out.append((rid[again], start[again], (start + n - 1 + length)[again], k[again], rid[first], start[first]))
                near = k[at][1:] == k[at][:-1]
                asked = np.concatenate([near, [False]]) | np.concatenate([[False], near]) | hot[at]
                was = bool(last and last[5])
                ask = asked.copy()
                if was:
                    ask[0] = False  # already asked for
                e = at[ask]
                out.append((rid[e], start[e], -n[e], k[e], rid[e], start[e]))
                z = at[-1]
                last = (*(int(x[z]) for x in (k, sh, rid, start, n)), bool(asked[-1]) or (was and len(at) == 1))
            columns = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)]
            other = np.ones(len(columns[0]), bool)  # only claims name another segment
            other[len(out[0][0]) : len(out[0][0]) + claimed] = False
            columns[4:] = [pa.array(c.to_numpy(), pa.int64(), mask=other) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "start", "stop", "k", "rid0", "start0"])

    apart = F.when(F.col("n") >= HOT_FLAG, F.col("sh")).otherwise(0)
    ordered = rows.repartition(width(rows.sparkSession), "k", apart).sortWithinPartitions("k", "sh", "n", "rid", "start")
    return ordered.mapInArrow(run, MARKS)


def claimed_ranges(claims: DataFrame) -> DataFrame:
    """(rid, start, stop, rid0, start0): claims of one text on another at one distance, joined where they touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, start, stop, rid0, start0 = (c.to_numpy() for c in b.columns)
            gap = start - start0
            new = np.ones(len(rid), bool)
            # Along one distance segments ascend in start and in stop alike.
            new[1:] = (rid[1:] != rid[:-1]) | (rid0[1:] != rid0[:-1]) | (gap[1:] != gap[:-1]) | (start[1:] > stop[:-1])
            at = np.flatnonzero(new)
            end = np.append(at[1:], len(rid))[: len(at)] - 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rid[at], start[at], stop[end], rid0[at], start0[at])], names=["rid", "start", "stop", "rid0", "start0"])

    rows = claims.select("rid", "start", "stop", "rid0", "start0").repartition(width(claims.sparkSession), "rid")
    rows = rows.sortWithinPartitions("rid", "rid0", F.col("start") - F.col("start0"), "start")
    return rows.mapInArrow(run, "rid long, start long, stop long, rid0 long, start0 long")


def claimed_bytes(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """FOUND: for each range that is claimed, the bytes that it is claimed to repeat."""
    asks = ranges.select(F.col("rid0").alias("rid"), F.struct(F.col("start0").alias("at"), "rid", "start", "stop").alias("ask"))
    often = settled(asks.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SERVED).select("rid", F.ceil(F.col("n") / SERVED).alias("deals")), "often")
    deal = F.lit(0)
    if not often.isEmpty():  # a text that very many others repeat answers in several rows
        asks = asks.join(often, "rid", "left")
        deal = F.pmod(F.xxhash64("ask.rid", "ask.start"), F.coalesce("deals", F.lit(1)))
    lists = asks.groupBy("rid", deal.alias("deal")).agg(F.collect_list("ask").alias("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            out = [(a["rid"], a["start"], a["stop"], text[a["at"] : a["at"] + a["stop"] - a["start"]]) for text, asked in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True) for a in asked]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["rid", "start", "stop", "bytes"])

    return texts.join(lists.select("rid", "asks").hint("shuffle_hash"), "rid").select("text", "asks").mapInArrow(run, FOUND)


CONTEXTS = "k long, rid long, start long, n long, bytes binary"


def contexts(asked: DataFrame, length: int) -> DataFrame:
    """CONTEXTS of texts with their lists of asked segments; windows of crowded anchors one by one.

    Repeats that show within a batch have n = -1 and their stop in k.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            rows: list[tuple[int, int, int, int, bytes]] = []
            single: dict[bytes, list[tuple[int, int]]] = {}
            for rid, text, wanted in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                for w in wanted:
                    start, n = w["start"], w["n"]
                    if not w["crowded"]:
                        rows.append((w["k"], rid, start, n, text[start : start + n - 1 + length]))
                        continue
                    for s in range(start, start + n):
                        single.setdefault(text[s : s + length], []).append((rid, s))
            repeats = []
            for window, places in single.items():
                places.sort()
                rows.append((xxhash.xxh64_intdigest(window) - (1 << 63), *places[0], 1, window))
                repeats += places[1:]
            if repeats:
                r, s = (np.array(x, np.int64) for x in zip(*repeats, strict=True))
                rows += [(z, rid, a, -1, b"") for rid, a, z in zip(*(x.tolist() for x in merged(r, s, s + length)), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["k", "rid", "start", "n", "bytes"])

    return asked.mapInArrow(run, CONTEXTS)


def repeated_windows(k: np.ndarray, rid: np.ndarray, start: np.ndarray, n: np.ndarray, parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(rid, start, stop) of windows that an earlier context of the same anchor holds too.

    Equal windows have their anchor at the same place, so only windows with the same
    anchor and the same distance to it are sorted against each other.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    h = PrefixHashes(data, 0)
    m = max(0, len(data) - GRAM + 1)
    context = np.repeat(np.arange(len(n)), sizes)[:m]
    met = np.flatnonzero(((h.sums[GRAM:] - h.sums[:m]) * h.inverse[:m]).view(np.int64) == k[context])
    anchor = begin.copy()  # a window that stands alone has no anchor to look for
    anchor[context[met][::-1]] = met[::-1]  # of several places the first is written last
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    distance = anchor[owner] - begin[owner] - place
    # In a block by the order of documents: a stable sort then puts the earliest of a class first.
    by = np.lexsort((start[owner], rid[owner], distance, k[owner]))
    owner, place, distance = owner[by], place[by], distance[by]
    block = np.cumsum(np.concatenate([[0], (k[owner][1:] != k[owner][:-1]) | (distance[1:] != distance[:-1])]))
    order, classes = equal_classes(data, begin[owner] + place, block, length, h)
    again = np.concatenate([[False], classes[1:] == classes[:-1]])
    found = order[again]
    s = start[owner[found]] + place[found]
    return merged(rid[owner[found]], s, s + length)


def sorted_contexts(rows: DataFrame, length: int) -> DataFrame:
    """FOUND, without bytes: the repeats among contexts, whole anchors together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> pa.RecordBatch:
            k, rid, start, n = (t.column(c).to_numpy() for c in range(4))
            return places(*map(pa.array, repeated_windows(k, rid, start, n, t.column(4).to_pylist(), length)))

        def places(*columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.binary())], names=["rid", "start", "stop", "bytes"])

        def folded(t: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
            """The repeats among rows of one window each, and the rows without them."""
            rid, start, n = (t.column(c).to_numpy() for c in (1, 2, 3))
            parts, seen = t.column(4).to_pylist(), set()
            again = np.zeros(len(n), bool)
            for j in np.lexsort((start, rid)).tolist():
                if n[j] == 1:
                    again[j] = parts[j] in seen
                    seen.add(parts[j])
            rid, start, stop = merged(rid[again], start[again], start[again] + length)
            return places(*map(pa.array, (rid, start, stop))), t.filter(pa.array(~again))

        held: list[pa.RecordBatch] = []
        windows, most = 0, SORT
        for b in batches:
            n = b.column(3).to_numpy()
            ready = b.filter(pa.array(n < 0))
            if ready.num_rows:
                yield places(ready.column(1), ready.column(2), ready.column(0))
            b = b.filter(pa.array(n > 0))
            if not b.num_rows:
                continue
            held.append(b)
            windows += int(n[n > 0].sum())
            if windows < most:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            k = t.column(0).to_numpy()
            edge = np.flatnonzero(k[1:] != k[:-1])
            if len(edge):
                yield found(t.slice(0, edge[-1] + 1))
                t = t.slice(edge[-1] + 1).combine_chunks()
            else:  # one window may be in very many documents
                ready, t = folded(t)
                yield ready
            held = t.combine_chunks().to_batches()
            windows = sum(int(h.column(3).to_numpy().sum()) for h in held)
            most = max(SORT, 2 * windows)
        if held:
            yield found(pa.Table.from_batches(held))

    return rows.repartition(width(rows.sparkSession), "k").sortWithinPartitions("k").mapInArrow(run, FOUND)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (rid, text, ranges): the result by rid, and the claims that do not hold."""
    for b in blocks(batches):
        lists = b.column(2)
        offsets, inner = lists.offsets.to_numpy(), lists.flatten()
        start, stop = (inner.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        claimed = inner.field(2)
        has = claimed.is_valid().to_numpy(zero_copy_only=False)
        at = np.cumsum(np.concatenate([[0], np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))]))
        sizes, removed, spans, kept, failed = [], [], [], [], []
        for row, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
            a, z = at[row], at[row + 1]
            holds = np.ones(z - a, bool)
            for j in np.flatnonzero(has[a:z]).tolist():
                holds[j] = text[start[a + j] : stop[a + j]] == claimed[a + j].as_py()
            failed.append([{"start": int(start[a + j]), "stop": int(stop[a + j])} for j in np.flatnonzero(~holds)])
            _, s, e = merged(np.zeros(int(holds.sum()), np.int64), start[a:z][holds], stop[a:z][holds])
            cuts = list(zip(s.tolist(), e.tolist(), strict=True))
            sizes.append(len(text))
            removed.append(int((e - s).sum()))
            spans.append([{"start": x, "stop": y} for x, y in cuts])
            kept.append(b"".join(text[x:y] for x, y in zip([0, *(y for _, y in cuts)], [*(x for x, _ in cuts), len(text)], strict=True)) if cuts else text)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(failed, kind)], names=["rid", "n_bytes", "n_removed", "spans", "kept", "failed"])


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), hash_bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans array<struct<start,stop>>, kept binary) for every document.

    ``spans`` are the maximal removed runs, in bytes of the UTF-8 text, ``kept`` the other
    bytes, joined (a cut may fall within a character).  Null texts are empty; texts under
    ``length`` bytes keep all.  Documents are ordered by ``common.with_row_ids``: rows
    that repeat a doc_id and a text are one document and each get its result; other rows
    with that doc_id are ordered by their texts' hashes, null ids come first.  ``length``
    must be over GRAM.  Columns of ``docs`` to ``keep`` return as they are, one that is
    named as a result column with ``_`` behind its name.  No byte goes unless it was
    compared; with fewer ``hash_bits`` segment hashes collide, which costs time only.
    """
    own, unique = with_row_ids(documents(docs, id_col, text_col, keep))
    # With this filter the plan is the same for inner and left joins: the texts are shuffled once.
    texts = own.select("rid", "text").filter("rid is not null")
    if not unique:
        texts = texts.dropDuplicates(["rid"])
    distrusted = np.zeros(0, np.int64)
    hot = hot_anchors(texts, length)
    while True:
        marks = settled(first_segments(segment_rows(texts, length, hot, hash_bits), length, distrusted), "marks")
        claims = marks.filter("rid0 is not null")
        ranges = settled(claimed_ranges(claims), "claims")
        asked = marks.filter("stop < 0").select("rid", "start", (-F.col("stop")).alias("n"), "k")
        crowded = settled(asked.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > LIMIT).select("k", F.lit(True).alias("crowded")), "crowded")
        if crowded.isEmpty():
            asked = asked.withColumn("crowded", F.lit(False))
        else:
            # One row for each crowded anchor: sent to all while that is small, shuffled beyond.
            asked = asked.join(F.broadcast(crowded) if crowded.count() <= 100_000 else crowded, "k", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
        wanted = asked.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "k", "crowded")).alias("wanted"))
        found = sorted_contexts(contexts(texts.join(wanted.hint("shuffle_hash"), "rid").select("rid", "text", "wanted"), length), length)
        sure = marks.filter("stop > 0 and rid0 is null").select("rid", "start", "stop", F.lit(None).cast("binary").alias("bytes"))
        found = found.unionByName(claimed_bytes(texts, ranges)).unionByName(sure)
        found = found.groupBy("rid").agg(F.collect_list(F.struct("start", "stop", "bytes")).alias("ranges"))
        joined = texts.join(found.hint("shuffle_hash"), "rid", "left").select("rid", "text", "ranges")
        kind = "array<struct<start:long,stop:long>>"
        out = settled(joined.mapInArrow(_cut, f"rid long, n_bytes long, n_removed long, spans {kind}, kept binary, failed {kind}"), "cut")
        failed = out.filter(F.size("failed") > 0).select(F.col("rid").alias("in_rid"), F.explode("failed").alias("f"))
        # Of colliding hashes alone: none in any text that was not made for it.
        bad = claims.join(failed, (F.col("rid") == F.col("in_rid")) & (F.col("start") >= F.col("f.start")) & (F.col("stop") <= F.col("f.stop"))) if not failed.isEmpty() else None
        if bad is None:
            drop_settled(marks, ranges, crowded)
            return for_each_row(out.drop("failed"), own, unique)
        distrusted = np.union1d(distrusted, bad.select("k").distinct().toArrow().column(0).to_numpy())
        drop_settled(marks, ranges, crowded, out)
