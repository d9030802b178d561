"""Near copies, repeated passages, fingerprints and licences against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata

import duckdb
import numpy as np
import pytest
import xxhash

from tabflow.llm import digests, licenses, neardup, passages, queries, suffixes, triejoin
from tabflow.llm.components import connected_components
from tabflow.llm.fingerprints import simhashes

SF_DIR = "/root/testdata/sf0.001"


def parts(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_simhash(text, words=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    grams = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "  ", "a", "A b", "a b c d", "É x É x É x", "w " * 100, "a b c d e\x1cf g"])
def test_simhash(text):
    assert int(simhashes(text)[0]) == plain_simhash(text)
    many = simhashes(text, 3, 4)
    assert int(many[0]) == plain_simhash(text)


@pytest.mark.parametrize("budget", [0, 1, 2, 4])
def test_trie_pairs(budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 1 << 64, 40, np.uint64)
    near = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, np.uint64)) for _ in range(6))])
    fps = np.unique(near)
    i, j = triejoin.trie_pairs(fps, np.array([0]), np.array([len(fps)]), budget)
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(got) == len(i)
    assert got == {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= budget}


@pytest.mark.parametrize("limit", [512, 40])
def test_near_links_lose_nothing(spark, limit):
    """With tiny subtries too, where crowded ones are cut again and again."""
    rng = np.random.default_rng(5)
    values = [int(x) for x in rng.integers(0, 1 << 64, 60, np.uint64)]
    values += [v ^ (1 << int(a)) ^ (1 << int(b)) for v in values for a, b in rng.integers(0, 64, (3, 2))]
    values += [(1 << k) - 1 for k in range(40)]
    values = sorted(set(values))
    fps = spark.createDataFrame([(0, triejoin.signed(x), k) for k, x in enumerate(values)], "part int, fp long, node long")
    links = [(r.src, r.dst) for r in triejoin.near_links(fps, 2, limit).collect()]
    expected = parts(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2])
    assert parts(len(values), links) == expected


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    expected = parts(600, [(a, b) for a, b in edges if a is not None])
    assert got == {n: expected[n] for e in edges if e[0] is not None for n in e}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_op2(spark):
    got = queries.op2_simhash_near_dedup(spark, SF_DIR).collect()
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY 1").fetchall()
    fps = [plain_simhash(t) for _, t in rows]
    root = parts(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[k]:016x}", rows[root[k]][0]) for k, (i, _) in enumerate(rows)}


def test_neardup_of_odd_rows(odd, nothing):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2, 5) and r.doc_id is not None} == {0}
    assert {r.component_id for r in got if r.doc_id == 3} == {3}
    assert neardup.near_duplicates(nothing).count() == 0
    assert len(neardup.near_duplicates(odd, 5, 4, 3).collect()) == odd.count()
    kept = neardup.representatives(odd)
    assert kept.columns == odd.columns
    assert {0, 3} <= {r.doc_id for r in kept.collect()}
    assert {r.doc_id for r in kept.collect()}.isdisjoint({1, 2})


def test_representatives_keep_all_columns(spark):
    """Columns that are named as the operator's own stay as they are."""
    rows = [(1, "a b c d", 7, 8, 9), (2, "a b c d", 7, 8, 9), (None, "a b c d", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id long, component_id long, id long")
    for options in ({}, {"words": 5, "budget": 4, "tables": 2}):
        kept = neardup.representatives(docs, **options)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2]], key=str)


def test_near_copies_of_five_word_shingles(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    rows = []
    for k in range(30):
        text = rng.choices(words, k=400)
        rows.append((2 * k, " ".join(text)))
        text[rng.randrange(400)] = "changed"
        rows.append((2 * k + 1, " ".join(text)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 16).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)


def plain_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                covered[k : k + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        out[i] = (len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest())
    return out


def hard_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé漢") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.randint(15, 80)) for _ in range(6)]
    rows = []
    for i in range(200):
        t = prose(rng.randint(0, 120))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 3)
            t += " " + p[a : rng.randint(len(p) // 2, len(p))] + " " + prose(rng.randint(0, 40))
        rows.append((i * 3, t))
    rows += [(5000 + i, rows[rng.randrange(200)][1]) for i in range(40)]
    for i in range(40):
        t = rows[rng.randrange(200)][1]
        k = rng.randrange(max(1, len(t)))
        rows.append((6000 + i, t[:k] + "X" + t[k + 1 :]))
    return rows + [(7000, "a" * 1000), (7001, "ab" * 700), (7002, "a" * 150 + "b" * 150), (7003, ""), (7004, "ab" * 300 + "a" * 300), (7005, prose(300) * 3), (7006, "a" * 99), (7007, "a" * 100)]


@pytest.mark.parametrize("limit", [1000, 4])
def test_passages(spark, monkeypatch, limit):
    """Exactly the bytes that brute force removes; also where anchors are crowded."""
    monkeypatch.setattr(passages, "LIMIT", limit)
    rows = hard_texts()
    got = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got} == plain_repeats(rows)


@pytest.mark.parametrize("bits", [0, 6, 12])
def test_hashes_of_segments_do_not_decide(spark, bits):
    """Segment hashes of few bits call different segments equal, in a task and across tasks; bytes still decide."""
    rows = hard_texts()
    got = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), hash_bits=bits).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got} == plain_repeats(rows)


@pytest.mark.parametrize("hot, bits", [(1, 64), (3, 64), (3, 6), (10**9, 64)])
def test_hot_anchors_and_windows(spark, monkeypatch, hot, bits):
    """The same bytes go whichever anchors are dealt by segment, and where rows of one window come in many batches."""
    rows = hard_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for name, value in (("HOT", hot), ("LIMIT", 2), ("SORT", 2)):
        monkeypatch.setattr(passages, name, value)
    found = passages.hot_anchors(docs.selectExpr("doc_id as rid", "text"), 100)
    assert (len(found) > 0) == (hot < 10**9) and (np.diff(found) > 0).all()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = passages.remove_repeats(docs, hash_bits=bits).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got} == plain_repeats(rows)


def test_two_segments_of_one_hash(spark):
    """Two texts around one anchor that share no 100 bytes keep all."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    anchor = letters(60)
    rows = [(k, letters(52) + anchor + letters(52)) for k in range(2)]
    for parts in (1, 2):
        got = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), hash_bits=0).collect()
        assert [r.n_removed for r in got] == [0, 0]


def test_kept_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "x" * 120, 5, 6, 7), (2, "x" * 120, 5, 6, 7)], "doc_id long, text string, n_bytes long, rid long, n_bytes_ long")
    got = passages.remove_repeats(docs, keep=("n_bytes", "rid", "n_bytes_"))
    assert got.columns == ["doc_id", "n_bytes_", "rid_", "n_bytes__", "n_bytes", "n_removed", "spans", "kept"]
    assert {(r.doc_id, r.n_bytes, r.n_bytes_, r.rid_) for r in got.collect()} == {(1, 120, 5, 6), (2, 120, 5, 6)}


def test_passages_of_odd_rows(odd, nothing, labels):
    got = passages.remove_repeats(odd, keep=("lang", "score"))
    rows = got.collect()
    assert len(rows) == odd.count()
    assert got.columns == ["doc_id", "lang", "score", "n_bytes", "n_removed", "spans", "kept"]
    by = {r.doc_id: r for r in rows}
    assert by[7].n_removed == 4900 - 0 * 100 or by[7].n_removed > 4800
    assert by[0].n_bytes == 0
    assert passages.remove_repeats(nothing).count() == 0


def test_slices_and_folds_do_not_matter(monkeypatch):
    """Segments of sliced texts give the same windows the same anchors."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    whole = passages.segments(data, np.array([0, 3000]), 100)
    assert int(whole[4].sum()) == 2901
    part = passages.segments(data[700:], np.array([0, 2300]), 100)
    owner = lambda s, base: {int(f) + base + k: (int(a)) for a, _, _, f, n in zip(*s, strict=True) for k in range(int(n))}
    a, b = owner(whole, 0), owner(part, 700)
    assert all(a[k] == b[k] for k in b)
    assert passages.segments(data[:99], np.array([0, 99]), 100)[0].size == 0


def test_suffix_sort():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    suffix = rng.permutation(3900)[:1500]
    blocks = np.sort(rng.integers(0, 20, 1500))
    h = suffixes.PrefixHashes(data, 0)
    order = suffixes.sort_suffixes(data, h, suffix, blocks, 50)
    key = lambda k: (blocks[k], data[suffix[k] : suffix[k] + 50].tobytes())
    assert order.tolist() == sorted(range(1500), key=key)
    order, classes = suffixes.equal_classes(data, suffix, blocks, 12, h)
    texts = [(blocks[k], data[suffix[k] : suffix[k] + 12].tobytes()) for k in order]
    assert all((texts[k] == texts[k - 1]) == (classes[k] == classes[k - 1]) for k in range(1, 1500))
    x, y = rng.integers(0, 3900, 300), rng.integers(0, 3900, 300)
    for a, b, n in zip(x, y, suffixes.common_prefix(h, x, y, 60), strict=True):
        own = next((k for k in range(60) if data[a + k] != data[b + k]), 60)
        assert n == own


def test_collisions_are_seen(monkeypatch):
    """With hashes that call everything equal, bytes still decide."""
    monkeypatch.setattr(suffixes.PrefixHashes, "of", lambda self, start, end: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"abcabcabdabc", np.uint8)
    h = suffixes.PrefixHashes(data, 0)
    order, classes = suffixes.equal_classes(data, np.array([0, 3, 6, 9]), np.zeros(4, np.int64), 3, h)
    assert classes[np.argsort(order)].tolist()[0] == classes[np.argsort(order)].tolist()[1] == classes[np.argsort(order)].tolist()[3]
    assert len(set(classes.tolist())) == 2


def test_merged():
    rid, start, stop = passages.merged(np.array([2, 1, 1, 1, 2]), np.array([0, 10, 0, 5, 100]), np.array([3, 20, 6, 10, 101]))
    assert list(zip(rid, start, stop, strict=True)) == [(1, 0, 20), (2, 0, 3), (2, 100, 101)]


def canon(t):
    n = unicodedata.normalize
    return re.sub(r"[\s\x1c-\x1f]+", " ", n("NFKC", n("NFKC", t).casefold())).strip(" ")


def wide(t):
    c = canon(t).encode()
    return f"{xxhash.xxh64_intdigest(c, 42):016x}{xxhash.xxh64_intdigest(c, xxhash.xxh64_intdigest(b'wide', 42)):016x}"


def test_op5(spark):
    rows = sorted(((i, t or "") for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()), reverse=True)
    got = {r.doc_id: r for r in queries.op5_fingerprints(spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        g = got[i]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (g.fingerprint, g.edited_fingerprint) == (wide(t), wide(edited))
        assert (g.near_edited, g.near_next) == (float(canon(t) == canon(edited)), float(canon(t) == canon(after)))


def test_exact_copies(spark, odd, nothing):
    rows = [(1, "Ｆｕｌｌ  WIDTH"), (2, "full width "), (3, "full-width"), (4, "STRASSE"), (5, "straße"), (6, None), (7, " "), (8, "é"), (9, "É")]
    got = {r.doc_id: r for r in digests.exact_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    groups = {i: r.group_id for i, r in got.items()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8}
    assert digests.exact_copies(odd).count() == odd.count()
    assert digests.likeness_to_edits(odd).count() == odd.count()
    assert digests.exact_copies(nothing).count() == 0
    assert digests.likeness_to_edits(nothing).count() == 0


def test_collided_digests_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(digests, "wide_hash", lambda c: F.lpad(F.substring(c, 1, 1), 32, "0"))
    rows = [(1, "ax"), (2, "ay"), (3, "AX"), (4, "b")]
    got = {r.doc_id: r.fingerprint for r in digests.exact_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[3] != got[2]
    assert len({*got.values()}) == 3


def test_op1(spark, odd, nothing):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    columns = ["doc_id", "license", "line_licenses", "n_license_lines"]
    got = [tuple(r) for r in queries.op1_license_scan(spark, SF_DIR).select(columns).collect()]
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL['op1_license_scan']})").fetchall()
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert any(r[2] for r in got)
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(nothing).count() == 0


def test_licenses(spark):
    rows = [
        (1, "MIT LICENSE\n\nCopyright (c) 2020 Someone\n\n" + licenses.MIT.replace('"', "“").replace(" of ", "   of ")),
        (2, licenses.ISC.upper()),
        (3, licenses.MIT + " and more"),
        (4, "Some text.\n  released under the MIT LICENCE!\nSPDX-License-Identifier: Apache-2.0"),
        (5, licenses.APACHE_NOTICE.replace("http://www.", "https://")),
        (6, None),
    ]
    got = {r.doc_id: (r.license, r.line_licenses, r.n_license_lines) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == "MIT"
    assert got[2][0] == "ISC"
    assert got[3][0] is None
    assert got[4] == (None, "Apache-2.0,MIT", 2)
    assert got[5][0] == "Apache-2.0"
    assert got[6] == (None, "", 0)


@pytest.mark.parametrize("width", [60, 79, 200])
def test_wrapped_licenses(spark, width):
    """Published forms: wrapped lines, comment signs, titles, holders, numbered and lettered clauses, other spellings."""
    import textwrap

    def wrapped(text, sign=""):
        return "\n".join(sign + x for p in text.split("\n\n") for x in [*textwrap.wrap(p, width), ""])

    head = "Copyright (c) 1999-2024, The Holders <x@example.org>\nAll rights reserved.\n\n"
    bsd = (licenses.BSD_2 + licenses.BSD_3_CLAUSE + licenses.WARRANTY_BSD).replace("copyright holder nor", "Example Corp. nor").replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")
    texts = [
        ("MIT", "The MIT License (MIT)\n\n" + head + wrapped(licenses.MIT)),
        ("MIT", "MIT License\n\nCopyright © 2020 Someone\n\n" + wrapped(licenses.MIT, "# ")),
        ("ISC", "ISC License\n\n" + head + wrapped(licenses.ISC)),
        ("ISC", head + wrapped(licenses.ISC.replace("AUTHOR DISCLAIMS", "AUTHORS DISCLAIM").replace("THE AUTHOR BE", "THE AUTHORS BE"))),
        ("BSD-2-Clause", "BSD 2-Clause License\n\n" + head + wrapped(licenses.BSD_2 + licenses.WARRANTY_BSD)),
        ("BSD-3-Clause", head + wrapped(bsd, " * ")),
        ("BSD-3-Clause", head + wrapped(bsd.replace("1. R", "a. R").replace("2. R", "* R").replace("3. N", "(c) N"))),
        ("BSL-1.0", wrapped(licenses.BOOST)),
        ("Zlib", "zlib License\n\n(C) 1995-2024 Two Authors\n\n" + wrapped(licenses.ZLIB)),
        ("Unlicense", wrapped(licenses.UNLICENSE + licenses.UNLICENSE_END)),
        ("0BSD", head + wrapped(licenses.KNOWN[4][1])),
        ("MIT-0", "Copyright 2024 A\n\n" + wrapped(licenses.KNOWN[1][1])),
        (None, wrapped(licenses.MIT) + "\nCopyright notices stay in place."),
        ("Own-1", "My own\n terms."),
    ]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs, known=[("Own-1", "my own terms")]).collect()}
    assert got == {k: name for k, (name, _) in enumerate(texts)}


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "CC0-1.0"])
def test_long_published_licenses(name):
    """Where the system has the published texts, their digests are those of the table, however they are wrapped."""
    from pathlib import Path

    path = Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no published texts here")
    text = path.read_text(errors="replace")
    known = dict(licenses.digests())
    assert known[licenses.digest_of(text)].startswith(name)
    assert known[licenses.digest_of("\n".join("// " + x for x in text.upper().split("\n")))].startswith(name)


def test_intermediate_tables_are_removed(spark):
    from pathlib import Path

    from tabflow.llm import common

    df = common.settled(spark.range(3), "gone")
    where = Path(df.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
    assert df.count() == 3
    assert where.exists()
    kept, common._SETTLED[:] = common._SETTLED[:-1], common._SETTLED[-1:]
    common.clear_settled(spark)
    common._SETTLED[:] = kept
    assert not where.exists()
