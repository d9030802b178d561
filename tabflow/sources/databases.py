"""Databases: SQLite through Python's own driver, others through JDBC."""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import zipfile
from collections.abc import Iterator, Sequence
from glob import glob
from urllib.parse import quote_plus

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringStartsWith

from ..functions import values as v
from ..functions.compiler import quoted
from . import scratch


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite_type(declared: str) -> T.DataType:
    """By the rules of SQLite's affinities; BOOL first."""
    d = declared.upper()
    if d.startswith("BOOL"):
        return T.BooleanType()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    return T.BinaryType() if "BLOB" in d else T.StringType()


class Rows(InputPartition):
    """The rowids from low up to high, or all rows."""

    def __init__(self, low: int | None = None, high: int | None = None):
        self.low, self.high = low, high


def condition(f: Filter, kinds: dict[str, T.DataType]) -> tuple[str, list] | None:
    """SQL that holds for every row that Spark's filter lets through, or None where there is no such.

    Spark applies its filters again: cells that do not fit their column's type are empty to it.
    """
    name = getattr(f, "attribute", ())
    if len(name) != 1 or name[0] not in kinds:
        return None
    column, kind = quote(name[0]), kinds[name[0]]
    if isinstance(f, IsNotNull):
        return f"{column} IS NOT NULL", []
    values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
    fits = {T.LongType: int, T.DoubleType: (int, float), T.StringType: str, T.BooleanType: bool}.get(type(kind))
    if fits is None or not all(isinstance(x, fits) for x in values):
        return None
    if isinstance(kind, T.BooleanType):
        return (f"{column} <> 0" if values[0] else f"{column} = 0", []) if isinstance(f, EqualTo) else None
    if isinstance(kind, T.StringType):
        column += " COLLATE BINARY"
    sign = {EqualTo: "=", EqualNullSafe: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}.get(type(f))
    if sign:
        return f"{column} {sign} ?", values
    if isinstance(f, In):
        return f"{column} IN ({', '.join('?' * len(values))})", values
    if isinstance(f, StringContains):
        return f"instr({quote(name[0])}, ?) > 0", values
    if isinstance(f, StringStartsWith):
        return f"substr({quote(name[0])}, 1, ?) = ? COLLATE BINARY", [len(values[0]), values[0]]
    return None


class SQLiteReader(DataSourceReader):
    """Reads ranges of rowids, one a task; a view, or a table without rowids, in one task.

    Filters that SQLite can evaluate go into its query, where its indexes serve them.
    """

    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.own = options, schema
        self.pushed: list[tuple[str, list]] = []

    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {f.name: f.dataType for f in self.own}
        # A column without a declared type holds any cells, and Spark sees them as texts: SQLite would not.
        kinds = {n: k for n, k in kinds.items() if n not in self.loose()}
        for f in filters:
            known = condition(f, kinds)
            if known:
                self.pushed.append(known)
            yield f

    def loose(self) -> set[str]:
        with self.connect() as db:
            declared = db.execute(f"PRAGMA table_info({quote(self.options['table'])})").fetchall()
        return {r[1] for r in declared if isinstance(sqlite_type(r[2] or ""), T.StringType) and not any(x in (r[2] or "").upper() for x in ("CHAR", "CLOB", "TEXT"))}

    def partitions(self) -> list[Rows]:
        with self.connect() as db:
            kind = db.execute("SELECT type FROM sqlite_master WHERE name = ? COLLATE NOCASE", (self.options["table"],)).fetchone()
            if not kind or kind[0] != "table":
                return [Rows()]
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quote(self.options['table'])}").fetchone()
            except sqlite3.OperationalError:
                return [Rows()]
        if not isinstance(low, int) or not isinstance(high, int):  # no rows, or a column of that name
            return [Rows()]
        n = max(1, int(self.options.get("partitions", 8)))
        step = max(1, -(-(high - low + 1) // n))
        return [Rows(a, a + step) for a in range(low, high + 1, step)]

    def query(self, partition: Rows) -> tuple[str, list]:
        parts = list(self.pushed)
        if partition.low is not None:
            parts.append(("rowid >= ? AND rowid < ?", [partition.low, partition.high]))
        names = ", ".join(quote(f.name) for f in self.own) or "NULL"
        where = " WHERE " + " AND ".join(f"({c})" for c, _ in parts) if parts else ""
        return f"SELECT {names} FROM {quote(self.options['table'])}{where}", [x for _, given in parts for x in given]

    def read(self, partition: Rows) -> Iterator[tuple]:
        kinds = [f.dataType for f in self.own]
        with self.connect() as db:
            for row in db.execute(*self.query(partition)):
                yield tuple(self.cell(x, k) for x, k in zip(row, kinds, strict=True))

    @staticmethod
    def cell(x: object, kind: T.DataType) -> object:
        """SQLite types cells, not columns: one that its column's type cannot hold is empty."""
        if x is None:
            return None
        match kind:
            case T.BooleanType():
                return bool(x) if isinstance(x, int) else None
            case T.LongType():
                return x if isinstance(x, int) else None
            case T.DoubleType():
                return float(x) if isinstance(x, (int, float)) else None
            case T.BinaryType():
                return x if isinstance(x, bytes) else None
        return x if isinstance(x, str) else str(x) if isinstance(x, (int, float)) else None


class SQLiteSource(DataSource):
    """``spark.read.format("sqlite_table").option("path", ...).option("table", ...)``; the file must be where tasks run."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            found = db.execute(f"PRAGMA table_info({quote(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        wanted = {c.lower() for c in json.loads(self.options.get("columns", "[]"))}
        return T.StructType([T.StructField(r[1], sqlite_type(r[2] or "")) for r in found if not wanted or r[1].lower() in wanted])

    def reader(self, schema: T.StructType) -> SQLiteReader:
        return SQLiteReader(dict(self.options), schema)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8, columns: Sequence[str] | None = None) -> DataFrame:
    """A table or view of a SQLite file; of ``columns`` only those are fetched, all without.

    Filters on it are evaluated by SQLite too.  Spark does not tell a source in Python which
    columns a query reads, hence their list.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).option("partitions", partitions).option("columns", json.dumps(list(columns or []))).load()


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "overwrite", batch: int = 1_000) -> None:
    """The table in a SQLite file, made anew or appended to, in one transaction.

    SQLite has one writer: rows come to the driver a partition at a time and none stays.
    """
    kinds = {v.LONG: "INT", v.DOUBLE: "REAL", v.BOOL: "BOOL", v.BYTES: "BLOB"}
    columns = ", ".join(f"{quote(f.name)} {kinds.get(v.kind_of(f.dataType)[0], 'TEXT')}" for f in df.schema)
    plain = df.select(*((df[quoted(f.name)] if v.kind_of(f.dataType)[0] in kinds else v.text(v.from_column(df[quoted(f.name)], f.dataType))).alias(f.name) for f in df.schema))
    db = sqlite3.connect(path, isolation_level=None)
    try:
        db.execute("BEGIN")
        if mode == "overwrite":
            db.execute(f"DROP TABLE IF EXISTS {quote(table)}")
        db.execute(f"CREATE TABLE IF NOT EXISTS {quote(table)} ({columns})")
        insert = f"INSERT INTO {quote(table)} VALUES ({', '.join('?' * len(df.columns))})"
        held: list[tuple] = []
        for row in plain.toLocalIterator():
            held.append(tuple(bytes(x) if isinstance(x, bytearray) else x for x in row))
            if len(held) == batch:
                db.executemany(insert, held)
                held = []
        db.executemany(insert, held)
        db.execute("COMMIT")
    except BaseException:
        db.execute("ROLLBACK")
        raise
    finally:
        db.close()


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') ORDER BY name")]


def related_tables(path: str, table: str) -> list[tuple[str, str]]:
    """(other table, join formula) for each foreign key of a SQLite table: joins to suggest."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        found = db.execute(f"PRAGMA foreign_key_list({quote(table)})").fetchall()
        out = []
        for r in found:
            key = r[4] or next((c[1] for c in db.execute(f"PRAGMA table_info({quote(r[2])})") if c[5]), "rowid")
            out.append((r[2], f"[{r[3]}]=#[{key}]"))
    return out


#: Drivers and the options with which they send many rows at once (fixed values).
DIALECTS: dict[str, tuple[str, int, dict[str, str]]] = {
    "mysql": ("com.mysql.cj.jdbc.Driver", 3306, {"rewriteBatchedStatements": "true"}),
    "mariadb": ("org.mariadb.jdbc.Driver", 3306, {"useBulkStmts": "true"}),
    "postgresql": ("org.postgresql.Driver", 5432, {"reWriteBatchedInserts": "true"}),
}


def jdbc_url(kind: str, host: str, database: str, port: int | None = None) -> str:
    """The address of a MySQL, MariaDB or PostgreSQL database, as its driver wants it."""
    if kind not in DIALECTS:
        raise ValueError(f"no database kind {kind}")
    host = f"[{host}]" if ":" in host else host
    return f"jdbc:{kind}://{host}:{port or DIALECTS[kind][1]}/{quote_plus(database)}"


def jdbc_options(url: str, user: str | None = None, password: str | None = None) -> dict[str, str]:
    """What reader and writer need besides the table: driver, who asks, and the driver's way to send many rows."""
    kind = url.split(":")[1] if url.startswith("jdbc:") else ""
    driver, _, many = DIALECTS.get(kind, (None, 0, {}))
    return {"url": url} | ({"driver": driver} if driver else {}) | many | ({"user": user} if user else {}) | ({"password": password} if password else {})


def read_jdbc(spark: SparkSession, url: str, table: str, user: str | None = None, password: str | None = None, key: str | None = None, low: int | None = None, high: int | None = None, partitions: int = 8) -> DataFrame:
    """A table of MySQL, MariaDB, PostgreSQL and others whose driver is on Spark's classpath.

    Filters, column choices, limits and simple aggregates are pushed to the database; with a
    numeric ``key``, tasks read ranges of it between its bounds, which are asked for if not given.
    """
    options = jdbc_options(url, user, password) | {"dbtable": table, "pushDownAggregate": "true", "pushDownLimit": "true", "pushDownOffset": "true"}
    if key is not None and (low is None or high is None):
        ends = spark.read.format("jdbc").options(**options).load().agg(F.min(quoted(key)), F.max(quoted(key))).first()
        low, high = ends[0] if low is None else low, ends[1] if high is None else high
    if key is not None and low is not None and high is not None:
        options |= {"partitionColumn": key, "lowerBound": str(int(low)), "upperBound": str(int(high) + 1), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", user: str | None = None, password: str | None = None, batch: int = 10_000, **options: str) -> None:
    """Creates or appends to a table: each task sends its rows in batches, in one transaction.

    A Derby database lives in one process, here the driver's: it takes up files that the tasks write.
    """
    if in_driver(url):
        fill_derby(df, url, table, mode, user, password, options)
        return
    df.write.format("jdbc").options(**(jdbc_options(url, user, password) | {"dbtable": table, "batchsize": str(batch)} | options)).mode(mode).save()


def in_driver(url: str) -> bool:
    """Whether the address is of a Derby database without a server: of one process, so tasks elsewhere cannot write to it."""
    return url.startswith("jdbc:derby:") and not url.startswith("jdbc:derby://")


def connection(spark: SparkSession, url: str, user: str | None = None, password: str | None = None):
    """The driver process's own connection."""
    who = spark._jvm.java.util.Properties()
    for k, x in jdbc_options(url, user, password).items():
        if k not in ("url", "driver"):
            who.setProperty(k, x)
    return spark._jvm.java.sql.DriverManager.getConnection(url, who)


def derby_text(x: Column, kind: T.DataType, zone: str) -> Column:
    """A cell as Derby's import reads it: quoted, or nothing where it is empty; times as they are in the driver's ``zone``, as JDBC has them."""
    match kind:
        case T.BinaryType():
            x = F.hex(x)
        case T.TimestampType():
            utc = F.timestamp_add("MICROSECOND", F.unix_micros(x), F.lit("1970-01-01").cast("timestamp_ntz"))
            x = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc).cast("string")
        case T.NumericType() | T.StringType() | T.BooleanType() | T.DateType() | T.TimestampNTZType():
            x = x.cast("string")
        case _:
            raise ValueError(f"Derby's import takes no {kind.simpleString()}")
    return F.coalesce(F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def fill_derby(df: DataFrame, url: str, table: str, mode: str, user: str | None, password: str | None, options: dict[str, str]) -> None:
    """The driver makes the table, tasks write their rows as texts into the shared folder, and Derby imports those files.

    No row goes through the driver's results.  Derby commits each file.
    """
    spark = df.sparkSession
    zone = spark._jvm.java.util.TimeZone.getDefault().getID()
    line = F.concat_ws(",", *(derby_text(df[quoted(f.name)], f.dataType, zone) for f in df.schema))
    *schema, name = spark._jvm.org.apache.derby.iapi.util.IdUtil.parseMultiPartSQLIdentifier(table)
    db = connection(spark, url, user, password)
    try:
        own = schema[-1] if schema else db.getSchema()
        if mode == "ignore" and db.getMetaData().getTables(None, own, name, None).next():
            return
        given = jdbc_options(url, user, password) | {"dbtable": table} | options
        df.limit(0).write.format("jdbc").options(**given).mode(mode).save()
        known = {c.lower(): c for c in spark.read.format("jdbc").options(**given).load().columns}
        folder = scratch.local_path(spark, ".rows")
        try:
            df.select(line).write.text(f"file://{folder}", compression="none")
            load = db.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_DATA(?, ?, ?, NULL, ?, ',', '\"', 'UTF-8', 0)")
            for k, x in enumerate((own, name, ",".join(known[c.lower()] for c in df.columns)), 1):
                load.setString(k, x)
            for part in sorted(glob(f"{folder}/part-*")):
                load.setString(4, part)
                load.execute()
        finally:
            shutil.rmtree(folder, ignore_errors=True)
    finally:
        db.close()


def derby_jar(spark: SparkSession, url: str, path: str) -> str:
    """Closes a Derby database in a folder of the driver and packs it into the file ``path``: the address at which all processes that see the file read it."""
    folder = url.removeprefix("jdbc:derby:").removeprefix("directory:").split(";")[0]
    if not os.path.isfile(f"{folder}/service.properties"):
        raise ValueError(f"no Derby database in the folder {folder}")
    try:
        connection(spark, f"jdbc:derby:{folder};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # Derby's way to say that it is closed
            raise
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as out:  # pages are read at their places: not compressed
        for d, _, names in os.walk(folder):
            for x in names:
                if not x.endswith(".lck"):
                    out.write(f"{d}/{x}", f"rows/{os.path.relpath(f'{d}/{x}', folder)}")
    return f"jdbc:derby:jar:({path})rows"


def jdbc_related_tables(spark: SparkSession, url: str, table: str, user: str | None = None, password: str | None = None) -> list[tuple[str, str]]:
    """(other table, join formula) for each foreign key of a table, by what its driver tells of any database."""
    db = connection(spark, url, user, password)
    try:
        found, keys = [], db.getMetaData().getImportedKeys(db.getCatalog(), None, table)
        while keys.next():
            found.append((keys.getString("PKTABLE_NAME"), keys.getString("FK_NAME"), keys.getString("FKCOLUMN_NAME"), keys.getString("PKCOLUMN_NAME")))
    finally:
        db.close()
    parts: dict[tuple[str, str], list[str]] = {}
    for other, name, mine, theirs in found:
        parts.setdefault((other, name), []).append(f"[{mine}]=#[{theirs}]")
    return [(other, p[0] if len(p) == 1 else f"AND({';'.join(p)})") for (other, _), p in parts.items()]
