"""Tokens, packing, sharding, quality and toxicity."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabflow.llm import bpe, labelled, neighbours, packing, quality_rules, queries, sharding, toxicity
from tabflow.llm.wordtokens import WordTokens

SF_DIR = "/root/testdata/sf0.001"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "th", "e", " ", "  ", "\n", "é", "漢", "😀", "'s", "'LL", "!", "...", "1", "½", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "\x1c", "　", "ß", "а", "​", "İ", "ΑΣ", "́", "ǅ"]


@pytest.fixture(scope="module")
def documents():
    return [(i, t or "") for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY 1").fetchall()]


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBPE(BYTES)


@pytest.fixture(scope="module")
def word_coder():
    return WordTokens(WORDS)


texts = st.one_of(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), st.text(max_size=60), st.tuples(st.sampled_from(PARTS), st.integers(1, 700)).map(lambda x: x[0] * x[1]))


@settings(max_examples=300, deadline=None)
@given(texts)
def test_bytes_as_the_library(coder, text):
    library = Tokenizer.from_file(BYTES)
    expected = library.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(coder.ids_bytes(text), "<i4").tolist()
    assert got == expected
    assert coder.decode(got) == library.decode(expected, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_words_as_the_library(word_coder, text):
    expected = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(word_coder.ids_bytes(text), "<u4").tolist() == expected


@pytest.mark.parametrize("leaf", [2, 7, 64])
def test_tree_of_any_leaf(leaf):
    own, library = bpe.ByteBPE(BYTES, leaf), Tokenizer.from_file(BYTES)
    rng = random.Random(leaf)
    for alphabet in ("abcdefthineing", "ab", "=-", "é漢", " "):
        text = "".join(rng.choices(alphabet, k=1500))
        assert own.unsplit(text.encode()) == library.encode(text, add_special_tokens=False).ids


def test_decoding_broken_bytes(coder):
    assert coder.decode([coder.single[0xE6], coder.single[ord("a")]]) == "�a"


def test_parts_of_long_pieces_in_tasks(spark, documents, odd, nothing):
    """Long unsplit pieces, cut into parts that tasks encode and join level by level, are as the library's."""
    rng = random.Random(9)
    texts = [t for _, t in documents[:30]] + ["ab" * 900, "x" * 1537, "".join(rng.choices("abcdet", k=5000)) + " end", "漢字" * 700, " " * 2000 + "z", "one <|endoftext|>" + "q" * 700 + "<|endoftext|>" + "7" * 1200, "", None, "é" * 600 + " " + "!?" * 900]
    rows = [(k // 2, t) for k, t in enumerate(texts)] + [(None, "w" * 3000)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    library = Tokenizer.from_file(BYTES)
    library.no_truncation()
    library.no_padding()
    expected = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=repr)
    for long, part in ((500, 64), (1, 7), (1500, 400)):
        got = bpe.encode(docs, BYTES, long=long, part=part).collect()
        assert sorted(((r.doc_id, list(r.ids)) for r in got), key=repr) == expected
    got = bpe.round_trip(docs, BYTES, long=500, part=100).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=repr) == expected
    assert sorted((r.text for r in got)) == sorted(t or "" for _, t in rows)
    assert bpe.round_trip(odd, BYTES, long=1, part=3).count() == odd.count()
    assert bpe.round_trip(nothing, BYTES, long=1, part=3).count() == 0


def test_op9(spark, documents, odd, nothing):
    library = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r for r in queries.op9_bpe(spark, SF_DIR).collect()}
    for i, t in documents:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(odd, BYTES)
    assert sorted((r.doc_id or -1, r.text) for r in bpe.decode(encoded, BYTES).collect()) == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    assert bpe.round_trip(nothing, BYTES).count() == 0


def test_op3(spark, documents):
    library = Tokenizer.from_file(WORDS)
    rows = queries.op3_best_fit_packing(spark, SF_DIR).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in documents:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        own = sorted(by.pop(i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 2048)))
        for r in own:
            assert r.start == 2048 * r.piece
            assert ids[r.start : r.start + r.length] == ids[r.start : r.start + 2048]
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in own) == len(ids)
    assert not by
    check_packed(rows, 2048, 1.03)


def check_packed(rows, capacity, slack):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        placed.sort()
        assert placed[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:]))
        assert sum(n for _, n in placed) <= capacity
    least = -(-sum(r.length for r in rows) // capacity)
    assert len(bins) <= max(least + 2, least * slack)


def plain_sum_of_squares(lengths, capacity, reuse=False):
    """Every open bin and a new one tried in turn; with ``reuse`` a new one only if none has room."""
    gaps = []
    for size in lengths:
        def cost(after):
            counts = Counter(g for g in after if g)
            return sum(n * n for n in counts.values())

        new = [(cost([*gaps, capacity - size]), 1, 0, None)]
        options = [(cost([*gaps[:k], g - size, *gaps[k + 1 :]]), 0, g, k) for k, g in enumerate(gaps) if g >= size]
        k = min(options if reuse and options else options + new, key=lambda o: o[:3])[3]
        if k is None:
            gaps.append(capacity - size)
        else:
            gaps[k] -= size
    return sorted(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.booleans())
def test_sum_of_squares_rule(lengths, reuse):
    bins, offsets, n = packing.sum_of_squares(np.array(lengths, np.int64), 30, reuse)
    fill = [0] * n
    for b, o, size in zip(bins, offsets, lengths, strict=True):
        assert fill[b] == o
        fill[b] += size
    assert sorted(30 - f for f in fill) == plain_sum_of_squares(lengths, 30, reuse)


def test_packing_odd_rows(spark, odd, nothing, monkeypatch):
    rows = packing.pack_documents(odd, WORDS, 16).collect()
    assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows}) == len(rows)
    check_packed(rows, 16, 1.2)
    assert packing.pack_documents(nothing, WORDS).count() == 0
    monkeypatch.setattr(packing, "GROUP", 5)
    check_packed(packing.pack_documents(odd, WORDS, 16).collect(), 16, 2)
    with_ids = packing.pieces(odd, WORDS, 16, with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in with_ids)


def test_op7(spark, documents):
    rows = sorted(queries.op7_sharding(spark, SF_DIR).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == [i for i, _ in documents]
    assert all(r["size"] == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) for r, (_, t) in zip(rows, documents, strict=True))
    shards = [r.shard for r in rows]
    assert shards == sorted(shards)
    totals = Counter()
    for r in rows:
        totals[r.shard] += r["size"]
    largest = max(r["size"] for r in rows)
    mean = sum(totals.values()) / 16
    assert all(abs(t - mean) <= largest for t in totals.values())
    for k in set(shards):
        assert [r.slot for r in rows if r.shard == k] == list(range(shards.count(k)))
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_shards_keep_columns_that_clash(spark):
    rows = [(k, 10 + k % 3, k + 1, k + 2, k + 3, k + 4, k + 5, "x") for k in range(50)]
    df = spark.createDataFrame(rows, "id long, size long, `index` long, part long, begin long, shard long, slot long, `odd name` string").repartition(3)
    out = sharding.contiguous_shards(df, "size", ["id"], 4)
    assert out.columns == ["id", "size", "index", "part", "begin", "shard_", "slot_", "odd name", "shard", "slot"]
    got = sorted(map(tuple, out.collect()))
    assert [r[:8] for r in got] == rows
    assert [r[8] for r in got] == sorted(r[8] for r in got)
    assert [r[9] for r in got] == [k - min(j for j in range(50) if got[j][8] == r[8]) for k, r in enumerate(got)]


def test_sharding_odd_rows(spark, odd, nothing):
    rows = sharding.shard_documents(odd, 4).collect()
    assert len(rows) == odd.count()
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert sharding.shard_documents(nothing).count() == 0
    many = spark.createDataFrame([(1, "same")] * 1000, "doc_id long, text string")
    assert sorted(Counter(r.shard for r in sharding.shard_documents(many, 10).collect()).values()) == [100] * 10


def plain_measures(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            marked |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


def test_op4(spark, documents):
    got = {r.doc_id: r for r in queries.op4_quality_rules(spark, SF_DIR).collect()}
    for i, t in documents:
        g, (n, chars, symbols, dup, repeat) = got[i], plain_measures(t)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, dup, repeat)
        failed = n < 50 or 100 * repeat > 50 * n
        assert g.base_failed == failed
        assert not (failed and g.kept)
    assert len(got) == len(documents)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "a", "#x|", "\n", " \n", " ", "é"]), max_size=40).map(" ".join))
def test_measures(text):
    assert quality_rules.measure(text)[:5] == plain_measures(text)


def test_quality_rules_agree_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.score_quality(docs).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept != bool(r.quality) for r in rows) <= 0.02 * len(rows)


def test_quality_rules_on_odd_rows(odd, nothing):
    rows = quality_rules.score_quality(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.kept is not None and r.base_failed is not None for r in rows)
    assert quality_rules.score_quality(nothing).count() == 0
    assert quality_rules.label_model({}, 3) == {}


def accuracy(spark, query, column, sf_dir="/root/testdata/sf0.1"):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = query(spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == r[column] for r in rows) / len(rows)


def test_held_out_accuracy(spark):
    assert accuracy(spark, queries.op6_toxicity, "toxic") > 0.97
    assert accuracy(spark, queries.op8_quality_classifier, "quality") > 0.97


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumns({c: F.when(labelled.held_out(), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for module in (toxicity, neighbours):
        a, b = (sorted(tuple(r) for r in module.score(docs, module.train(docs, x)).collect()) for x in (labels, turned))
        assert a == b


@pytest.mark.parametrize("module", [toxicity, neighbours])
def test_classifiers_on_odd_rows(spark, odd, nothing, labels, module):
    model = module.train(odd, labels)
    assert module.score(odd, model).count() == odd.count()
    assert all(0 <= r.score <= 1 for r in module.score(odd, model).collect())
    assert module.accept(odd, model).columns == odd.columns
    assert module.score(nothing, model).count() == 0
    none = module.train(nothing, labels)
    assert all(0 <= r.score <= 1 for r in module.score(odd, none).collect())
    assert module.score(odd, module.train(odd, labels.limit(0))).count() == odd.count()


def test_neighbours_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = neighbours.train(docs, labels, k=5)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = dict(tuple(r) for r in neighbours.score(docs, model).collect())
    for i, t in rows:
        x = model.embed([t])[0]
        cosine = model.vectors @ x
        near = np.sort(cosine)[-5:]
        at = np.argsort(cosine, kind="stable")[-5:]
        w = np.maximum(cosine[at].astype(float), 0) ** 4
        if w.sum() > 0 and (cosine >= near[0] - 1e-6).sum() == 5:
            assert got[i] == pytest.approx((w * model.labels[at]).sum() / w.sum(), abs=1e-4)


def test_neighbours_are_fitted_without_the_whole_matrix(spark):
    """The driver's Python stays under a fourth of documents x terms float32, and all sampled documents are neighbours."""
    words = ", ' ', ".join(f"'w', (id * 7 + {13 * k}) % 500" for k in range(10))
    docs = spark.range(8000).selectExpr("id as doc_id", f"concat({words}) as text")
    labels = spark.range(8000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    tracemalloc.start()
    try:
        model = neighbours.train(docs, labels, n_terms=512, dims=4)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    own = [i for i in range(8000) if zlib.crc32(str(i).encode()) % 5]
    assert model.vectors.shape == (len(own), 4) and len(model.index) > 500
    assert np.allclose(np.linalg.norm(model.vectors, axis=1), 1, atol=1e-5)
    assert np.allclose(model.vectors, model.embed([" ".join(f"w{(i * 7 + 13 * k) % 500}" for k in range(10)) for i in own]), atol=1e-4)
    assert peak < len(own) * len(model.index)
