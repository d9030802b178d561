"""The table algebra against small literal tables."""

from __future__ import annotations

import pytest

from tabflow.functions.aggregates import Aggregator
from tabflow.functions.formula import FormulaError
from tabflow.operators import pieces
from tabflow.operators.dataset import Dataset, Join, Order
from tabflow.operators.names import default_name, new_name


@pytest.fixture(scope="module")
def xyz(spark):
    return Dataset(spark.createDataFrame([(i, i + 1, i + 2) for i in range(1000)], "X long, Y long, Z long"))


@pytest.fixture(scope="module")
def people(spark):
    return Dataset(spark.createDataFrame([("a", 1, "x,y"), ("b", None, ""), ("a", 3, None), (None, 4, "z")], "name string, n long, tags string"))


def rows(table):
    return sorted((tuple(r) for r in table.rows()), key=repr)


def test_names():
    assert [default_name(k) for k in (0, 25, 26, 27, 52)] == ["A", "Z", "BA", "BB", "CA"]
    assert new_name("x", ["X", "x_a"]) == "x_B"


def test_filter_takes_true_and_one_only(people):
    assert len(people.filter("n").rows()) == 1
    assert len(people.filter("n>0").rows()) == 3
    assert len(people.filter('"1"').rows()) == 4
    assert len(people.filter("1/0").rows()) == 0
    assert len(people.filter("NULL").rows()) == 0


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2.0 as d", "'x' as s").write.parquet(str(tmp_path / "t"))
    df = Dataset(spark.read.parquet(str(tmp_path / "t"))).filter("AND(id=5;d>1.5)").select(["id"]).df
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<id:bigint,d:" in plan
    assert "PushedFilters: [" in plan


def test_limits(xyz):
    assert len(xyz.limit(10).offset(5).rows()) == 5
    assert len(xyz.random(7, 1).rows()) == 7
    assert len(set(xyz.random(2000).rows())) == 1000
    assert xyz.limit(0).rows() == []


def test_calculate_is_simultaneous(xyz):
    got = xyz.limit(1).calculate({"x": "Y", "Y": "X", "W": "@", "Z": "@+1"})
    assert got.columns == ["X", "Y", "Z", "W"]
    assert tuple(got.rows()[0]) == (1, 0, 3.0, None)
    with pytest.raises(FormulaError):
        xyz.calculate({"a": "#X"})
    with pytest.raises(FormulaError):
        xyz.calculate({"a": "nothing"})


def test_select_and_rename(xyz):
    assert xyz.select(["z", "none", "X"]).columns == ["Z", "X"]
    assert xyz.rename({"x": "Y"}).columns == ["Y", "Z"]
    assert pieces.move_columns(xyz, ["Z"], "X").columns == ["Z", "X", "Y"]
    assert pieces.move_columns(xyz, ["X"]).columns == ["Y", "Z", "X"]


def test_union_by_name(spark, xyz):
    other = Dataset(spark.createDataFrame([(1, "t")], "x long, B string"))
    out = xyz.union(other)
    assert out.columns == ["X", "Y", "Z", "B"]
    assert len(out.rows()) == 1001
    mixed = Dataset(spark.createDataFrame([("t",)], "Y string"))
    assert dict(xyz.union(mixed).df.dtypes)["Y"] == "string"


def test_joins(spark, xyz):
    other = Dataset(spark.createDataFrame([(i, i * 2, -i) for i in range(0, 1000, 2)], "x long, B long, C long"))
    left = xyz.join(Join(other, "X=#x"))
    assert left.columns == ["X", "Y", "Z", "B", "C"]
    assert len(left.rows()) == 1000
    assert len(xyz.join(Join(other, "X=#x", "inner")).rows()) == 500
    assert xyz.join(Join(xyz, "X=#X", "inner")) is xyz
    theta = xyz.limit(3).join(Join(other.limit(2), "OR(X=#x;X<#B)", "inner"))
    assert all(r.X == r.B / 2 or r.X < r.B for r in theta.rows())
    both = xyz.join(Join(other, "AND(X=#x;Y>#B)", "inner"))
    assert [r.X for r in both.rows()] == [0]


def test_join_of_empties(spark):
    a = Dataset(spark.createDataFrame([(None, 1)], "k string, p long"))
    b = Dataset(spark.createDataFrame([(None, 2)], "k string, q long"))
    assert len(a.join(Join(b, "k=#k", "inner")).rows()) == 0
    assert len(a.join(Join(b, "k=#k", "inner", nulls_match=True)).rows()) == 1


def test_aggregates(people):
    a = Aggregator
    got = people.aggregate({"who": "UPPER(name)"}, {"s": a("n", "sum"), "c": a("n", "count"), "all": a("n", "countAll"), "list": a("n", "list", order=("n",)), "few": a("n", "sum", minimum_count=2), "p": a("tags", "pack", order=("n",))})
    by = {r.who: r for r in got.rows()}
    assert by["A"].s == 4.0
    assert by["A"].c == by["A"]["all"] == 2
    assert by["A"].few == 4.0
    assert by["B"].few is None
    assert by["B"]["list"] == [None]
    assert by["A"].p == "x$0y,"
    total = people.aggregate({}, {"strict": a("n", "sum", strict=True), "plain": a("n", "sum"), "d": a("name", "countDistinct")}).rows()[0]
    assert tuple(total) == (None, 8.0, 2)
    assert people.filter("FALSE").aggregate({}, {"c": a("1", "countAll")}).rows()[0].c == 0


def test_text_extremes(people):
    assert people.aggregate({}, {"m": Aggregator("name", "max")}).rows()[0].m == "b"


def test_pivot(spark):
    t = Dataset(spark.createDataFrame([("r1", "a", 1, 10), ("r1", "b", 2, 20), ("r2", None, 3, 30)], "r string, c string, v long, w long"))
    out = t.pivot(["c"], ["r"], ["v", "w"])
    assert out.columns == ["r", "_v", "_w", "a_v", "a_w", "b_v", "b_w"]
    assert rows(out) == sorted([("r1", None, None, 1, 10, 2, 20), ("r2", 3, 30, None, None, None, None)], key=repr)
    assert t.pivot([], ["r"], ["v"]) is t


def test_pivot_keeps_alike_labels_apart(spark):
    """Cells whose joined texts are alike, empties, and the last of several rows."""
    t = Dataset(spark.createDataFrame([("a_b", "c", 1), ("a", "b_c", 2), ("", None, 3), (None, "", 4), ("1", "", 5), ("1", "", 6), ("1", "", None)], "s string, t string, v long").coalesce(1))
    out = t.pivot(["s", "t"], [], ["v"])
    assert len(out.columns) == len({c.lower() for c in out.columns}) == 5
    assert sorted(out.rows()[0], key=repr) == [1, 2, 3, 4, None]
    again = t.filter("NOT(ISEMPTY(v))").pivot(["s", "t"], [], ["v"])
    assert sorted(again.rows()[0]) == [1, 2, 3, 4, 6]


def test_left_joins_without_keys_send_no_large_side(spark, monkeypatch):
    from tabflow.operators import dataset

    a = Dataset(spark.createDataFrame([(1, "x"), (5, None), (5, None), (9, "z"), (None, "q")], "i long, s string"))
    b = Dataset(spark.createDataFrame([(k, k * k) for k in range(8)], "j long, k long"))
    small = a.join(Join(b, "AND(i<#j;#k>30)")).rows()
    monkeypatch.setattr(dataset, "SENT_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = a.join(Join(b, "AND(i<#j;#k>30)"))
        assert "BroadcastNestedLoop" not in large.df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, large.rows()), key=repr) == sorted(map(tuple, small), key=repr)
        assert large.columns == ["i", "s", "j", "k"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_kept_tables_are_released(spark):
    from tabflow.operators import kept

    t = Dataset(spark.range(10)).rank({"n": Aggregator("1", "countAll")}, [Order("id")])
    assert len(t.rows()) == 10
    assert kept._KEPT
    own = kept._KEPT[-1]
    kept.release()
    assert not kept._KEPT
    assert not own.is_cached


def test_flatten_and_transpose(spark):
    t = Dataset(spark.createDataFrame([("p", 1, 2), ("q", 3, 4)], "k string, a long, b long"))
    flat = t.flatten("value", "column", "[k]", "id")
    assert flat.columns == ["id", "column", "value"]
    assert len(flat.rows()) == 6
    turned = t.transpose()
    assert turned.columns == ["A", "p", "q"]
    assert [tuple(r) for r in turned.rows()] == [("a", 1, 3), ("b", 2, 4)]
    back = turned.transpose()
    assert [tuple(r) for r in back.rows()] == [("p", 1, 2), ("q", 3, 4)]
    with pytest.raises(ValueError, match="not transposed"):
        t.transpose(most=1)


def test_rank_two_passes_equals_window(spark):
    t = Dataset(spark.createDataFrame([(i, (i * 7919) % 101, float(i % 13) if i % 5 else None) for i in range(500)], "i long, k long, v double"))
    orders = [Order("k", False), Order("i")]
    values = {r: Aggregator("v", r) for r in ("sum", "average", "count", "countAll", "min", "max")}
    got = {r.i: r for r in t.rank(values, orders).rows()}
    rows_ = sorted(t.rows(), key=lambda r: (-r.k, r.i))
    seen = []
    for n, r in enumerate(rows_, 1):
        if r.v is not None:
            seen.append(r.v)
        g = got[r.i]
        assert g.countAll == n
        assert g["count"] == len(seen)
        if seen:
            assert g["sum"] == pytest.approx(sum(seen))
            assert g["average"] == pytest.approx(sum(seen) / len(seen))
            assert (g["min"], g["max"]) == (min(seen), max(seen))
    slow = t.limit(30).rank({"m": Aggregator("i", "median"), "d": Aggregator("k", "countDistinct")}, [Order("i")])
    assert slow.rows()[-1].m == 14.5


def test_sorting_of_empties(people):
    assert [r.n for r in people.sort([Order("n")]).rows()] == [None, 1, 3, 4]
    assert [r.n for r in people.sort([Order("n", False)]).rows()] == [4, 3, 1, None]
    assert [r.name for r in people.sort([Order("name", numeric=False), Order("n")]).rows()] == [None, "a", "a", "b"]


def test_pieces(people):
    down = pieces.explode_down(people, "tags")
    assert sorted(r.tags for r in down.rows()) == ["x", "y", "z"]
    across = pieces.explode_across(people, "tags", ["t1", "t2"])
    assert across.columns == ["name", "n", "t1", "t2"]
    assert ("a", 1, "x", "y") in rows(across)
    assert pieces.explode_across(people, "tags").columns == ["name", "n", "tags_0", "tags_1", "tags_2"]
    assert pieces.dummies(people, "name").columns == ["name", "n", "tags", "name_", "name_a", "name_b"]
    assert len(pieces.search(people, "X").rows()) == 1
    assert len(pieces.search(people, "").rows()) == 4
    assert len(pieces.filter_set(people, {"name": ["a"], "n": [1, None]}).rows()) == 1
    assert len(pieces.filter_set(people, {"name": []}).rows()) == 0
    assert len(pieces.filter_set(people, {"name": ["a", None]}, inverse=True).rows()) == 1
    profile = pieces.column_profile(people, "n").rows()[0]
    assert (profile.cells, profile.distinct, profile.empty, profile.minimum, profile.maximum) == (4, 3, 1, 1, 4)
    assert pieces.dissect(["a", 0], "j") == 'FROM.JSON([j])->"a"[1]'


def test_batches(xyz):
    sizes = [len(b) for b in xyz.batches(256)]
    assert sum(sizes) == 1000
    assert max(sizes) == 256


def test_numbered_batches_are_those_of_rows_as_they_come(spark):
    ids = Dataset(spark.range(0, 1000, 1, 7).filter("id < 300 or id > 720").withColumnRenamed("id", "__place"))  # partitions of unlike sizes, some empty
    for size in (1, 7, 256, 579, 5000):
        got: dict[int, list] = {}
        for r in ids.numbered(size, "no").rows():
            got.setdefault(r.no, []).append(r["__place"])
        assert [sorted(got[k]) for k in range(len(got))] == [[r["__place"] for r in b] for b in ids.batches(size)]
    assert ids.numbered(300, "__PLACE").columns == ["__PLACE"]
    assert Dataset(spark.range(0)).numbered().rows() == []
    with pytest.raises(ValueError, match="at least one"):
        ids.numbered(0)


def test_batches_of_rows_leaves_rows_with_the_tasks(spark, tmp_path, monkeypatch):
    from tabflow.plans.queries import QUERIES

    def no(*args, **options):
        raise AssertionError("rows to the driver")

    spark.range(0, 10_001, 1, 3).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/full/orders.parquet")
    spark.range(0).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/none/orders.parquet")
    with monkeypatch.context() as m:
        for name in ("collect", "toLocalIterator", "toArrow", "toPandas"):
            m.setattr(type(spark.range(0)), name, no)
        full, none = (QUERIES["batches_of_rows"](spark, f"{tmp_path}/{x}") for x in ("full", "none"))
    assert full.dtypes == [("rows", "bigint"), ("batches", "bigint")]
    assert [tuple(r) for r in full.collect() + none.collect()] == [(10_001, 40), (0, 0)]


def test_empty_table(spark):
    t = Dataset(spark.createDataFrame([], "a long, b string"))
    assert t.filter("a>1").sort([Order("a")]).distinct().rows() == []
    assert t.rank({"n": Aggregator("1", "countAll")}, [Order("a")]).rows() == []
    assert t.pivot(["b"], ["a"], ["a"]).rows() == []
    assert t.flatten("v").rows() == []
    assert t.aggregate({"a": "a"}, {"n": Aggregator("1", "countAll")}).rows() == []


def test_equalities_are_join_keys(spark):
    a = Dataset(spark.createDataFrame([(i, f"N{i}") for i in range(9)], "i long, s string"))
    b = Dataset(spark.createDataFrame([(i, f"n{i}", i * 2) for i in range(9)], "j long, t string, k long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for formula, n in (("i=#j", 9), ("AND(LOWER(s)=#t;#k>3)", 7), ("AND(i+1=#k/2+1;LEFT(s;1)=UPPER(LEFT(#t;1)))", 9)):
            joined = a.join(Join(b, formula, "inner"))
            assert "SortMergeJoin" in joined.df._jdf.queryExecution().executedPlan().toString()
            assert len(joined.rows()) == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
