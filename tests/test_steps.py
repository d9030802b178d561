"""Chains of steps, streams and the registered queries."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from tabflow.functions.aggregates import Aggregator
from tabflow.operators import steps as s
from tabflow.plans import queries as core
from tabflow.streaming import micro

SF_DIR = "/root/testdata/sf0.001"


def chain(*steps):
    return s.Chain(list(steps))


ROWS = s.Rows("g string, n long, t string", [["a", 1, "x y"], ["a", 2, "z"], ["b", 3, None], ["b", 3, None]])


def result(spark, *steps, **others):
    table = s.Workspace({"own": chain(ROWS, *steps), **others}).full(spark, "own")
    return table.columns, sorted((tuple(r) for r in table.rows()), key=repr)


def test_each_step(spark, tmp_path):
    assert len(result(spark, s.Filter("n>1"), s.Filter('g="b"'))[1]) == 2
    assert len(result(spark, s.FilterSet({"g": ["a"]}))[1]) == 2
    assert len(result(spark, s.Search("z"))[1]) == 1
    assert len(result(spark, s.Limit(3), s.Limit(2))[1]) == 2
    assert len(result(spark, s.Offset(1), s.Offset(2))[1]) == 1
    assert len(result(spark, s.RandomRows(2, 1))[1]) == 2
    assert len(result(spark, s.Distinct(), s.Distinct())[1]) == 3
    assert result(spark, s.Calculate("m", "n*2", behind="g"))[0] == ["g", "m", "n", "t"]
    assert result(spark, s.Calculate("m", "n*2", before="g"))[0] == ["m", "g", "n", "t"]
    assert result(spark, s.Calculate("N", "@*2"))[1][0][1] == 2.0
    assert result(spark, s.SelectColumns(["t", "g"]))[0] == ["g", "t"]
    assert result(spark, s.SelectColumns(["t", "g"]), s.SelectColumns(["t"]))[0] == ["t"]
    assert result(spark, s.RemoveColumns(["t"]), s.RemoveColumns(["N"]))[0] == ["g"]
    assert result(spark, s.MoveColumns(["t"], "g"))[0] == ["t", "g", "n"]
    assert result(spark, s.Rename({"g": "h"}))[0] == ["h", "n", "t"]
    assert result(spark, s.Sort([{"formula": "n"}]), s.Rank("place", [{"formula": "n", "ascending": False}]))[0][-1] == "place"
    assert result(spark, s.Pivot(["g"], [], {"total": {"formula": "n", "reducer": "sum"}}))[1] == [("a", 3.0), ("b", 6.0)]
    assert result(spark, s.Pivot([], ["g"], {"n": {"formula": "n", "reducer": "sum"}}))[1] == [(3.0, 6.0)]
    assert result(spark, s.Flatten("v", "c", row_id_to="row"))[0] == ["row", "c", "v"]
    assert result(spark, s.Limit(1), s.Transpose())[1] == [("n", "1"), ("t", "x y")]
    assert len(result(spark, s.ExplodeVertically("t", separator=" "))[1]) == 3
    assert result(spark, s.ExplodeHorizontally("t", ["p"], separator=" "))[0] == ["g", "n", "p"]
    assert result(spark, s.Dummies("g"))[0] == ["g", "n", "t", "g_a", "g_b"]
    assert len(result(spark, s.Cache(), s.Debug("materialize"), s.Debug("delay", 0.01), s.Debug())[1]) == 4
    assert len(result(spark, s.Merge("other"), other=chain(ROWS))[1]) == 8
    assert len(result(spark, s.JoinChain("other", "g=#g", "inner"), other=chain(ROWS, s.Rename({"n": "m"})))[1]) == 8
    assert len(s.Workspace({"own": chain(s.Clone("other")), "other": chain(ROWS)}).full(spark, "own").rows()) == 4
    out = str(tmp_path / "out.parquet")
    assert len(result(spark, s.Export("parquet", out))[1]) == 4
    assert spark.read.parquet(out).count() == 4
    assert len(s.Workspace({"own": chain(s.Source("range", {"low": 1, "high": 9}))}).full(spark, "own").rows()) == 9


def test_preview_writes_nothing(spark, tmp_path):
    work = s.Workspace({"own": chain(s.Source("range", {"low": 1, "high": 99}), s.Export("csv", str(tmp_path / "no")))})
    assert len(work.preview(spark, "own", rows=500, source_rows=10).rows()) == 10
    assert not (tmp_path / "no").exists()


def test_fusion():
    fused = chain(ROWS, s.Filter("n>1"), s.Filter("n<3"), s.Sort([{"formula": "n"}]), s.Sort([{"formula": "g"}]), s.Limit(5), s.Limit(9), s.Offset(1), s.Offset(1)).fused()
    assert [x.kind for x in fused] == ["Rows", "Filter", "Sort", "Limit", "Offset"]
    assert (fused[3].rows, fused[4].rows) == (5, 2)


def test_loops_and_json():
    with pytest.raises(ValueError, match="depends on itself"):
        s.Workspace({"a": chain(s.Clone("b")), "b": chain(ROWS, s.Merge("a"))})
    with pytest.raises(ValueError, match="no chain"):
        s.Workspace({"a": chain(s.Clone("x"))})
    work = s.Workspace({"a": chain(ROWS, s.Filter("n>1"), s.Calculate("m", '"é"&n')), "b": chain(s.Clone("a"))})
    again = s.Workspace.from_json(work.to_json())
    assert {k: c.steps for k, c in again.chains.items()} == {k: c.steps for k, c in work.chains.items()}


def test_suggestions(spark):
    picked = s.suggest_filters({"g": "b", "n": 3, "t": None})
    assert [x.formula for x in picked] == ['[g]="b"', "[n]=3", "[t]=NULL"]
    assert len(result(spark, *picked)[1]) == 2


def test_streams(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 as g").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, g long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    micro.each_batch(stream, chain(s.Filter("g=1"), s.Calculate("d", "id*2")), lambda df, n: got.extend(df.collect()), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(r.d for r in got) == [2.0 * i for i in range(100) if i % 3 == 1]
    kept = micro.running_groups(micro.row_steps(stream, chain(s.Filter("g<2"))), {"g": "g"}, {"n": Aggregator("1", "countAll"), "s": Aggregator("id", "sum")})
    q = kept.writeStream.outputMode("complete").format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.g: (r.n, r.s) for r in spark.table("kept").collect()} == {0: (34, 1683.0), 1: (33, 1617.0)}
    with pytest.raises(ValueError, match="whole table"):
        micro.row_steps(stream, chain(s.Distinct()))


def test_growing(spark):
    from tabflow.operators.dataset import Dataset

    sizes = [t.df.count() for t in micro.growing(spark, Dataset(spark.range(10)), 4)]
    assert sizes == [4, 8, 10]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query_equals_oracle(spark, oracle, name):
    df = core.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    found = oracle.sql(core.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted(got, key=repr) == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
