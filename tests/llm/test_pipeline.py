"""Every stage of the pipeline on its own input."""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))
import plain
from test_similar import classes

from tabflow.llm import neardup, neighbours, packing, passages, toxicity
from tabflow.llm.common import settled

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of each stage."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = {}
    for name, stage in pipeline.STAGES:
        after = settled(stage(spark, docs, SF_DIR), f"test-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_shapes(stages):
    for name, (before, after) in stages.items():
        if name != "best_fit_packing":
            assert after.columns == before.columns == list(pipeline.COLUMNS)
            assert [t for _, t in after.dtypes] == [t for _, t in before.dtypes]
    assert 0 < stages["best_fit_packing"][0].count() < stages["toxicity"][0].count()


def test_rejections_take_effect(spark, stages):
    labels = pipeline.labels(spark, SF_DIR)
    before, after = stages["toxicity"]
    model = toxicity.train(before, labels)
    assert ids(after) == ids(toxicity.score(before, model).filter("score < 0.5"))
    before, after = stages["quality_classifier"]
    model = neighbours.train(before, labels)
    assert ids(after) == ids(neighbours.score(before, model).filter("score >= 0.3"))


def test_one_of_each_class_stays(stages):
    before, after = stages["simhash_near_dedup"]
    found = neardup.near_duplicates(before, 5, 4, 16)
    assert ids(after) == {r.component_id for r in found.collect()}
    assert after.count() == after.select("text").distinct().count()


def test_repeats_are_cut(stages):
    before, after = stages["suffix_array_dedup"]
    assert ids(before) == ids(after)
    sizes = passages.remove_repeats(before).selectExpr("doc_id", "n_bytes", "n_removed")
    rows = after.join(sizes, "doc_id").join(before.select("doc_id", F.col("text").alias("old")), "doc_id").collect()
    assert sum(r.n_removed for r in rows) > 0
    for r in rows:
        assert len(r.text) == r.n_chars
        assert (r.text == r.old) == (r.n_removed == 0)
        assert r.n_bytes - r.n_removed - 6 * len(r.text) <= len(r.text.encode()) <= r.n_bytes - r.n_removed
    assert passages.remove_repeats(after).agg(F.sum("n_removed")).first()[0] <= 0.001 * sum(r.n_bytes for r in rows)


def test_all_is_packed(stages):
    before, after = stages["best_fit_packing"]
    assert ids(before) == ids(after)
    pieces = packing.pieces(before, pipeline.public_tokenizers.path("word_bpe_49k.json"))
    assert after.agg(F.sum("length")).first()[0] == pieces.agg(F.sum("length")).first()[0]


def test_run_gives_the_last_stage(spark, stages):
    rows = pipeline.run(spark, SF_DIR)
    assert rows.columns == stages["best_fit_packing"][1].columns
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, stages["best_fit_packing"][1].collect()))


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_rejections_by_plain_scores(spark, stages):
    """Both filters against scores in loops over single texts (the lexicon and its weights are the trained ones)."""
    labels = pipeline.labels(spark, SF_DIR)
    before, after = stages["toxicity"]
    model = toxicity.train(before, labels)
    assert ids(after) == {i for i, t in texts(before).items() if plain.toxic_score(model, t) < 0.5}
    before, after = stages["quality_classifier"]
    own = plain.Quality(sorted(texts(before).items()), {r.doc_id: r.quality for r in labels.collect()})
    kept = ids(after)
    for i, t in texts(before).items():
        low, high = own.bounds(t)
        assert i in kept if low > 0.302 else i not in kept if high < 0.298 else True


def test_near_copies_by_all_pairs(stages):
    before, after = stages["simhash_near_dedup"]
    assert ids(after) == set(classes(texts(before).items()).values())


def test_repeats_by_plain_search(stages):
    """What stays of each text are the characters that no repeated 100 bytes touch, by a set of all windows."""
    before, after = stages["suffix_array_dedup"]
    kept, seen = texts(after), set()
    for i, t in sorted(texts(before).items()):
        data = t.encode()
        covered = bytearray(len(data))
        for k in range(len(data) - 99):
            window = hash(data[k : k + 100])
            if window in seen:
                covered[k : k + 100] = b"\1" * 100
            seen.add(window)
        at, own = 0, []
        for c in t:
            size = len(c.encode())
            if not any(covered[at : at + size]):
                own.append(c)
            at += size
        assert kept[i] == "".join(own)


def test_packing_by_plain_rule(stages):
    """Pieces by the tokenizer itself; places by the sum of squares, counted anew for every choice."""
    before, after = stages["best_fit_packing"]
    tokenizer = Tokenizer.from_file(pipeline.public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    expected = []
    for i, t in texts(before).items():
        own = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        expected += [(i, k, 2048 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(-(-len(own) // 2048)) for p in [own[2048 * k : 2048 * (k + 1)]]]
    rows = after.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 2048
    open_: list[int] = []
    for length in sorted((n for *_, n, _ in expected), reverse=True):
        count = lambda gaps: sum(gaps.count(g) ** 2 for g in set(gaps) if g)
        choices = []
        for g in set(open_):
            if g >= length:
                k = open_.index(g)
                choices.append((count([*open_[:k], g - length, *open_[k + 1 :]]), 0, g, k))
        choices.append((count([*open_, 2048 - length]), 1, 2048, -1))
        _, new, g, k = min(choices)
        if new:
            open_.append(2048 - length)
        else:
            open_[k] = g - length
    assert len(bins) == len(open_)


def test_odd_and_empty_tables(spark, odd, nothing, tmp_path):
    odd.sparkSession.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (odd, nothing):
        docs = table.select(*pipeline.COLUMNS)
        for name, stage in pipeline.STAGES:
            docs = settled(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        assert docs.count() >= 0


def test_only_cut_characters_go(spark):
    """A U+FFFD of the text itself stays, whatever is cut elsewhere; parts of cut characters go."""
    passage = "".join(chr(0x4E00 + k) for k in range(60))
    rows = [(1, "x\ufffdy " + passage + " z\ufffd"), (2, "a\ufffdb " + passage + " c\ufffdd é"), (3, "\ufffd"), (4, "\ufffd" + chr(0x4E00 + 200) + passage[1:] + "\ufffd")]
    docs = spark.createDataFrame([(i, t, "zh", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.cut_repeats(spark, docs, SF_DIR).collect()}
    assert got[1] == (rows[0][1], rows[0][1].__len__())
    assert got[2][0] == "a\ufffdbc\ufffdd é" or got[2][0] == "a\ufffdb c\ufffdd é"
    assert got[3][0] == "\ufffd"
    assert got[4][0].startswith("\ufffd" + chr(0x4E00 + 200))
    assert got[4][0].endswith("\ufffd")
    assert all(n == len(t) for t, n in got.values())


@pytest.mark.parametrize("text", ["aé漢😀b", "漢漢漢", "\ufffd漢\ufffd", "ab"])
def test_whole_characters(text):
    """For every two cuts, the characters that no cut touches."""
    data = text.encode()
    places = [(len(text[:k].encode()), len(text[: k + 1].encode()), c) for k, c in enumerate(text)]
    n = len(data)
    cuts = [[(a, b)] for a in range(n) for b in range(a + 1, n + 1)]
    cuts += [[(a, b), (c, d)] for a in range(n) for b in range(a + 1, n) for c in range(b + 1, n) for d in range(c + 1, n + 1)]
    for own in cuts:
        kept = bytes(x for k, x in enumerate(data) if not any(a <= k < b for a, b in own))
        whole = "".join(c for lo, hi, c in places if not any(a < hi and lo < b for a, b in own))
        assert pipeline.whole_characters(kept, *map(list, zip(*own, strict=True))).decode() == whole
