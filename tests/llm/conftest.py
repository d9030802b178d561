from __future__ import annotations

import pytest

ODD_TEXTS = ["", "", None, "a", "a", " \t\n", "word " * 30, "x" * 5000, "é漢字 ﬁ　text", "line\nline\nline"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows, ties, extra columns with names that operators use."""
    rows = [(k, t, "en", "s", 1, k, "h", 0.5, 7) for k, t in enumerate(ODD_TEXTS)]
    rows += [(3, "a", "en", "s", 1, 1, "h", 0.5, 7)] * 2 + [(None, "no id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (4, "other text under a known id", "en", "s", 1, 1, "h", 0.5, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid long, hash string, score double, `index` long").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
