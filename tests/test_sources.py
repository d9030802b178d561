"""Files, databases, sequences and crawling."""

from __future__ import annotations

import datetime
import decimal
import json
import os
import sqlite3
import subprocess
import sys
import time
from pathlib import Path

import pyspark
import pytest

from tabflow.functions.sequencer import Sequence, range_table, sequence_table
from tabflow.operators.dataset import Dataset
from tabflow.operators.tables import Table
from tabflow.sources import crawl, databases, dbase, files, registry

GOLDEN = {
    "regular": ("a;b;c\n1;2;3\n4;5;6\n7;8;9", ["a", "b", "c"], [(1, 2, 3), (4, 5, 6), (7, 8, 9)]),
    "extraneous": ("a;b;c\n1;2;3\n4;5;6;10\n7;8;9", ["a", "b", "c"], [(1, 2, 3), (4, 5, 6), (7, 8, 9)]),
    "missing": ("a;b;c\n1;2\n4;5;6\n7;8;9", ["a", "b", "c"], [(1, 2, None), (4, 5, 6), (7, 8, 9)]),
    "escapes": ('"a;a";b;c\n1;"a;\nb";3\n4;5;6', ["a;a", "b", "c"], [(1, "a;\nb", 3), (4, "5", 6)]),
    "twice": ("a;a\n1,5;x\n2;y", ["a", "a_A"], [("1,5", "x"), ("2", "y")]),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_csv(spark, tmp_path, name):
    text, columns, expected = GOLDEN[name]
    path = tmp_path / "t.csv"
    path.write_text(text)
    df = files.read_csv(spark, str(path))
    assert df.columns == columns
    assert [tuple(r) for r in df.collect()] == expected


def test_csv_locale_and_no_header(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("1.000,5;x\n2;y")
    df = files.read_csv(spark, str(path), header=False, decimal=",", grouping=".")
    assert [tuple(r) for r in df.collect()] == [(1000.5, "x"), (2.0, "y")]
    assert df.columns == ["A", "B"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a;"b"\nc', 1.5, True), (2, None, None, None)], "i long, t string, d double, b boolean")
    files.write_csv(df, str(tmp_path / "out"))
    got = files.read_csv(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 'a;"b"\nc', 1.5, 1), (2, None, None, None)]


def test_json(spark, tmp_path):
    def read(data):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(data))
        return files.read_json(spark, str(path))

    objects = read([{"a": 1, "b": "x"}, {"b": "y", "c": 3}])
    assert objects.columns == ["a", "b"]
    assert [tuple(r) for r in objects.collect()] == [(1, "x"), (None, "y")]
    assert [r.items for r in read([1, 2]).select("items").collect()] != []
    assert read({"a": 1}).columns == ["data"]
    assert read([]).count() == 0


def test_text_xml_http(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert files.read_text(spark, str(tmp_path / "t.txt")).first().Data == "one\ntwo"
    files.write_xml(spark.createDataFrame([("a<b", 1)], "t string, n long").coalesce(1), str(tmp_path / "x"))
    text = "".join(p.read_text() for p in (tmp_path / "x").glob("part-*"))
    import xml.etree.ElementTree as ET

    root = ET.fromstring(text)
    assert [[c.text for c in row] for row in root.iter("row")] == [["t", "n"], ["a<b", "1"]]
    assert crawl.read_http(spark, (tmp_path / "t.txt").as_uri()).first().Data == "one\ntwo"
    assert crawl.read_http(spark, "file:///nowhere").first().Data is None


def test_dbf(spark, tmp_path):
    path = str(tmp_path / "t.dbf")
    dbase.write_dbf(spark.createDataFrame([("é", 1), (None, 2)], "name string, n long"), path)
    got = dbase.read_dbf(spark, path)
    assert sorted(got.collect(), key=str) == sorted([("é", "1"), (None, "2")], key=str)


def test_dbf_types(spark, tmp_path):
    fields = [(b"N", b"N", 5, 0), (b"D", b"N", 8, 2), (b"L", b"L", 1, 0), (b"C", b"C", 4, 0)]
    rows = [b" " + b"   42" + b"    1.50" + b"T" + b"ab  ", b"*" + b"    1" + b"    1.00" + b"F" + b"gone", b" " + b"     " + b"        " + b"?" + b"    "]
    data = dbase.HEADER.pack(3, 124, 1, 1, 3, 32 * 5 + 1, 19) + b"".join(dbase.FIELD.pack(*f) for f in fields) + b"\r" + b"".join(rows) + b"\x1a"
    (tmp_path / "t.dbf").write_bytes(data)
    assert [tuple(r) for r in dbase.read_dbf(spark, str(tmp_path / "t.dbf")).collect()] == [(42, 1.5, True, "ab"), (None, None, None, None)]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "t.sqlite")
    df = spark.createDataFrame([(i, f"n{i}", i / 2, i % 2 == 0) for i in range(100)], "i long, t string, d double, b boolean")
    databases.write_sqlite(df, path, "own table")
    got = databases.read_sqlite(spark, path, "own table", 4)
    assert got.dtypes == df.dtypes
    assert sorted(got.collect()) == sorted(df.collect())
    databases.write_sqlite(df.limit(5), path, "own table", mode="append")
    assert databases.read_sqlite(spark, path, "own table").count() == 105
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE child (p INT REFERENCES parent(id))")
    assert databases.sqlite_tables(path) == ["child", "own table"]
    assert databases.related_tables(path, "child") == [("parent", "[p]=#[id]")]


def test_sqlite_views_and_tables_without_rowids(spark, tmp_path):
    path = str(tmp_path / "t.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE a (i INT, t TEXT, d REAL, b BOOL, x)")
        db.executemany("INSERT INTO a VALUES (?,?,?,?,?)", [(k, f"n{k}", k / 2, k % 2, k) for k in range(100)])
        db.execute("INSERT INTO a VALUES ('odd', x'00', 'q', 't', 'z')")
        db.execute("CREATE VIEW v AS SELECT i, t FROM a WHERE i < 10")
        db.execute("CREATE TABLE w (k TEXT PRIMARY KEY, n INT) WITHOUT ROWID")
        db.execute("INSERT INTO w VALUES ('a', 1), ('b', 2)")
        db.execute("CREATE TABLE e (i INT)")
        db.execute("CREATE TABLE r (rowid TEXT, n INT)")
        db.execute("INSERT INTO r VALUES ('first', 1), ('last', 2)")
    read = lambda name, **kw: databases.read_sqlite(spark, path, name, **kw)
    assert {t: read(t).count() for t in databases.sqlite_tables(path)} == {"a": 101, "v": 10, "w": 2, "e": 0, "r": 2}
    assert read("a", columns=["I", "t"]).columns == ["i", "t"]
    whole = {r.i: r for r in read("a").collect()}
    assert tuple(whole[None]) == (None, None, None, None, "z")
    for condition in ("i >= 97", "i in (3, 5, 200)", "t = 'n7'", "t > 'n97'", "t like 'n9%'", "contains(t, '5')", "d < 1.5", "b", "not b", "x = '5'", "i <=> 4", "i is null", "t is not null and d > 48"):
        got = sorted(map(str, read("a").filter(condition).collect()))
        assert got == sorted(map(str, spark.createDataFrame(list(whole.values()), read("a").schema).filter(condition).collect())), condition


def test_filters_become_sql():
    from pyspark.sql import types as T
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringContains, StringStartsWith

    kinds = {"i": T.LongType(), "t": T.StringType(), "b": T.BooleanType()}
    sql = lambda f: databases.condition(f, kinds)
    assert sql(GreaterThan(("i",), 4)) == ('"i" > ?', [4])
    assert sql(In(("i",), (1, 2))) == ('"i" IN (?, ?)', [1, 2])
    assert sql(EqualTo(("t",), "a")) == ('"t" COLLATE BINARY = ?', ["a"])
    assert sql(StringContains(("t",), "a")) == ('instr("t", ?) > 0', ["a"])
    assert sql(StringStartsWith(("t",), "ab")) == ('substr("t", 1, ?) = ? COLLATE BINARY', [2, "ab"])
    assert sql(IsNotNull(("t",))) == ('"t" IS NOT NULL', [])
    assert sql(EqualTo(("b",), True)) == ('"b" <> 0', [])
    assert sql(GreaterThan(("i",), "4")) is None
    assert sql(EqualTo(("other",), 1)) is None
    reader = databases.SQLiteReader({"table": 'a"b'}, T.StructType([T.StructField("i", T.LongType())]))
    reader.pushed.append(sql(GreaterThan(("i",), 4)))
    assert reader.query(databases.Rows(1, 9)) == ('SELECT "i" FROM "a""b" WHERE ("i" > ?) AND (rowid >= ? AND rowid < ?)', [4, 1, 9])


def test_jdbc(spark):
    url = "jdbc:derby:memory:tabflow_test;create=true"
    df = spark.range(10).selectExpr("id", "id / 2.0D AS half", "concat('n', id) AS name")
    databases.write_jdbc(df, url, "OWN_ROWS", mode="overwrite", batch=3)
    databases.write_jdbc(df, url, "OWN_ROWS")
    got = databases.read_jdbc(spark, url, "OWN_ROWS", key="ID", partitions=3)
    assert got.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.union(df).collect()))
    plan = got.filter("id > 6").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(id), *GreaterThan(id,6)]" in plan
    db = spark._jvm.java.sql.DriverManager.getConnection(url)
    for sql in ("CREATE TABLE one (a INT NOT NULL, b INT NOT NULL, PRIMARY KEY (a, b))", "CREATE TABLE many (x INT, y INT, FOREIGN KEY (x, y) REFERENCES one)"):
        db.createStatement().execute(sql)
    db.close()
    assert databases.jdbc_related_tables(spark, url, "MANY") == [("ONE", "AND([X]=#[A];[Y]=#[B])")]


def test_derby_file_holds_every_cell(spark, tmp_path):
    at = datetime.datetime(2020, 7, 2, 3, 4, 5, 678901)
    rows = [(1, 'a;"b"c,\r\nd ', 5e-324, True, b"\x00\xff", at.date(), at, at, decimal.Decimal("-1.25")), (2**63 - 1, "", -1e300, False, b"", None, None, None, None), (3, *[None] * 8)]
    df = spark.createDataFrame(rows, "`id x` long, t string, d double, b boolean, y binary, day date, z timestamp, n timestamp_ntz, m decimal(10,2)").repartition(2)
    url = f"jdbc:derby:{tmp_path}/rows;create=true"
    databases.write_jdbc(df, url, '"Own, rows"', mode="overwrite")
    databases.write_jdbc(df.select("t", "id x").filter("`id x` = 1"), url, '"Own, rows"')
    databases.write_jdbc(df, url, '"Own, rows"', mode="ignore")
    with pytest.raises(Exception, match="not defined"):
        databases.write_jdbc(spark.range(1), url, '"Own, rows"')
    with pytest.raises(ValueError, match="no array"):
        databases.write_jdbc(spark.createDataFrame([([1],)], "a array<int>"), url, "other")
    got = databases.read_jdbc(spark, databases.derby_jar(spark, url, str(tmp_path / "t.jar")), '"Own, rows"')
    assert sorted(map(tuple, got.collect()), key=str) == sorted([*rows, (1, rows[0][1], *[None] * 7)], key=str)
    with pytest.raises(ValueError, match="no Derby"):
        databases.derby_jar(spark, "jdbc:derby:memory:x", str(tmp_path / "u.jar"))


CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__

home = sys.argv[1]
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", f"file://{home}/shared").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.executor.memory", "700m").getOrCreate()
print(sorted(map(tuple, __spark_entry__.queries()["jdbc_round_trip"](spark, sys.argv[2]).collect())))
"""


def test_jdbc_among_processes(spark, tmp_path):
    """Executors that are processes of their own: what they share is the folder for checkpoints."""
    for p in Path(pyspark.__file__).parent.iterdir():  # executors work in Spark's home
        if p.name != "work":
            (tmp_path / p.name).symlink_to(p)
    repo, data = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"
    env = os.environ | {"SPARK_HOME": str(tmp_path), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(repo), "PYSPARK_PYTHON": sys.executable}
    env = {k: x for k, x in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path), data], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    want = spark.read.parquet(f"{data}/supplier.parquet").filter("s_suppkey > 5").select("s_suppkey", "s_name", "s_acctbal")
    assert out.stdout.strip() == str(sorted(map(tuple, want.collect()))), out.stderr[-3000:]


def test_jdbc_options():
    assert databases.jdbc_url("postgresql", "db.example", "sales data") == "jdbc:postgresql://db.example:5432/sales+data"
    assert databases.jdbc_url("mysql", "::1", "x", 3307) == "jdbc:mysql://[::1]:3307/x"
    with pytest.raises(ValueError, match="no database kind"):
        databases.jdbc_url("other", "h", "d")
    assert databases.jdbc_options("jdbc:mysql://h/d", "me") == {"url": "jdbc:mysql://h/d", "driver": "com.mysql.cj.jdbc.Driver", "rewriteBatchedStatements": "true", "user": "me"}
    assert databases.jdbc_options("jdbc:postgresql://h/d")["reWriteBatchedInserts"] == "true"
    assert databases.jdbc_options("jdbc:derby:x") == {"url": "jdbc:derby:x"}


def test_csv_is_cut_only_where_no_quoted_line_ends(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b\n" + "".join(f"{k};n{k}\n" for k in range(5000)))
    (tmp_path / "q.csv").write_text('a;b\n1;"x\ny"\n2;z\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        many = files.read_csv(spark, str(tmp_path / "t.csv"))
        assert many.rdd.getNumPartitions() > 1
        assert many.count() == 5000
        assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "q.csv")).collect())) == [(1, "x\ny"), (2, "z")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


SEQUENCES = {
    "[pq]{3}": ["ppp", "ppq", "pqp", "pqq", "qpp", "qpq", "qqp", "qqq"], "[k\\t]x": ["kx", "\tx"], "plain": ["plain"], "(un)do": ["undo"], "(un)?do": ["do", "undo"], "[mn][\\]]": ["m]", "n]"],
    "[6-9]": ["6", "7", "8", "9"], "[gh]|[uvw]": list("ghuvw"), "[0-1]{2}[Z-X]": [], "([st]|[o])[47]": ["s4", "s7", "t4", "t7", "o4", "o7"], "(r|(ed)?)[5]": ["r5", "5", "ed5"], "(a|b)(c)?": ["a", "ac", "b", "bc"],
}


@pytest.mark.parametrize("pattern", SEQUENCES)
def test_sequences(spark, pattern):
    got = [r.Value for r in sequence_table(spark, pattern).collect()]
    assert sorted(got) == sorted(SEQUENCES[pattern])


def test_cardinality(spark):
    assert Sequence.parse("[a-e]{6}").cardinality == 5**6
    assert Sequence.parse("([0-9]{3}[A-F])|([A-F]{2}\\.[0-9])").cardinality == 6000 + 360
    assert Sequence.parse("([xy]?[0-4]){2}").cardinality == 15**2
    assert Sequence.parse("[0-9]{60}").cardinality is None
    assert Sequence.parse("[0-4][a-Z]").cardinality == 5 * 52
    for bad in ("]", "[k", "(k", "k{y}", "|)"):
        with pytest.raises(ValueError, match="no sequence"):
            Sequence.parse(bad)
    assert sequence_table(spark, "[k-t]{4}").distinct().count() == 10**4
    assert [r.Value for r in range_table(spark, 7, 9).collect()] == [7, 8, 9]
    with pytest.raises(ValueError, match="greater"):
        range_table(spark, 6, 6)


def test_crawl(spark):
    def fake(url):  # inside: workers do not import this module
        if url.endswith("3"):
            raise OSError("down")
        return 200, "body of " + url

    table = Dataset(spark.range(5).coalesce(1))
    began = time.monotonic()
    out = crawl.crawl(table, '"http://x/"&id', "body", "status", "error", "took", concurrent=2, per_second=20, fetcher=fake)
    got = {r.id: r for r in out.rows()}
    assert time.monotonic() - began >= 0.2
    assert got[1].body == "body of http://x/1"
    assert got[1].status == 200
    assert got[3].body is None
    assert got[3].error == "down"
    assert out.columns == ["id", "body", "status", "error", "took"]


def test_registry(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b\n1;2")
    assert registry.open_file(spark, str(tmp_path / "t.csv")).collect() == [(1, 2)]
    df = spark.range(3)
    registry.write(df, "parquet", str(tmp_path / "p.parquet"))
    assert registry.open_file(spark, str(tmp_path / "p.parquet")).count() == 3
    with pytest.raises(ValueError, match="no format"):
        registry.format_of("x.unknown")


def test_tables(spark, tmp_path):
    t = Table.create(spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string"), str(tmp_path / "t"), ["k"])
    t.insert({"K": 3, "unknown": 1})
    t.import_rows(spark.createDataFrame([("4", "d")], "id string, name string"), {"k": "id", "t": "name"})
    t.update({"k": 1}, "t", "a", "A")
    t.update({"k": 2}, "t", "not this", "B")
    t.delete([{"k": 3}])
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "A"), (2, "b"), (4, "d")]
    t.alter({"t": "string", "extra": "double"})
    assert t.read().columns == ["t", "extra"]
    t.rename({"t": "text"})
    assert t.read().columns == ["text", "extra"]
    t.truncate()
    assert t.read().count() == 0
    t.vacuum()
    with pytest.raises(ValueError, match="computed"):
        Table(spark, str(tmp_path / "t"), computed=["text"]).update({}, "TEXT", None, "x")
    t.drop()
    with pytest.raises(ValueError, match="no table"):
        t.read()
