"""What the operators share: intermediate tables, row ids and global order."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
_SETTLED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary one is made, but only if all tasks run on this
    machine (master ``local``, as in tests); elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _OWN:
        own = tempfile.TemporaryDirectory(prefix="tabflow-")
        atexit.register(own.cleanup)
        _OWN["dir"] = f"file://{own.name}"
    return _OWN["dir"]


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Cuts the lineage: whatever reads it later neither repeats the work nor depends
    on an executor that has been lost.  ``drop_settled`` removes it, ``clear_settled``
    all that are left.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tabflow-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SETTLED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_settled(*tables: DataFrame) -> None:
    """Removes tables that ``settled`` gave, when whatever reads them has been settled itself."""
    for t in tables:
        if t.settled_path in _SETTLED:
            _SETTLED.remove(t.settled_path)
        _remove(t.sparkSession, t.settled_path)


def settled_paths() -> list[str]:
    """The intermediate tables of this driver that are there."""
    return list(_SETTLED)


def clear_settled(spark: SparkSession, *keep: DataFrame, others: Sequence[str] = ()) -> None:
    """Removes all intermediate tables of this driver but those to ``keep`` and the paths of ``others``: call it when results have been written."""
    kept = {t.settled_path for t in keep} | set(others)
    for path in [p for p in _SETTLED if p not in kept]:
        _SETTLED.remove(path)
        _remove(spark, path)


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id long, text string), null texts empty; columns to ``keep`` in a struct ``rest``."""
    rest = [F.struct(*keep).alias("rest")] if keep else []
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *rest)


#: How to empty what a worker keeps between tasks, by name; modules enter theirs.
CACHES: dict[str, Callable[[], None]] = {}


def blocks(batches: Iterator[pa.RecordBatch], rows: int = 512, cache: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, without copying: few texts are Python strings at a time.

    A worker serves one operator after another: what others have kept in it is released
    first, all but ``cache``.
    """
    for name, empty in CACHES.items():
        if name != cache:
            empty()
    pa.default_memory_pool().release_unused()
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def filtered(df: DataFrame, text_col: str, keeps: Callable[[list[str]], list[bool]], cache: str | None = None) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose whole texts ``keeps`` calls true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, cache=cache):
            texts = ["" if t is None else t for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield b.filter(pa.array(keeps(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)


#: The places that ``monotonically_increasing_id`` has for the rows of a partition (fixed value).
PLACES = 33


def ordered_index(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``index`` (0, 1, ...) in the order of ``keys``, nulls first.

    Range partitions are sorted and counted; only the counts of partitions meet on
    the driver.  ``df`` should hold keys and sizes, not texts, and no column ``index``,
    ``tie`` or ``place``.  Rows that tie in all keys get neighbouring numbers in any order.
    """
    place = F.monotonically_increasing_id()  # partition and row of a sorted partition in one number
    rows = settled(_ranged(df, keys).withColumn("place", place), "ranged")
    part = F.shiftright("place", PLACES).cast("int")
    before = _before(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")), ["n"])
    rows = rows.withColumn("part", part).join(F.broadcast(before), "part")  # one row for each partition
    return rows.withColumn("index", F.col("place").bitwiseAND(F.lit((1 << PLACES) - 1)) + F.col("n")).drop("part", "place", "n")


def prefix_sums(df: DataFrame, keys: list[str], size: str, index: str, begin: str) -> DataFrame:
    """Adds ``index`` (0, 1, ... in the order of ``keys``, nulls first) and ``begin``, the sum of ``size`` over all earlier rows.

    One exchange by range: each sorted partition numbers its rows and sums their sizes
    once, and is written; totals by partition are as many rows as there are partitions,
    are summed on the driver and sent back.  Rows that tie are in any order.
    """
    ranged = _ranged(df, keys)
    added = [T.StructField("part", T.IntegerType()), T.StructField(index, T.LongType()), T.StructField(begin, T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sizes = b.column(b.schema.get_field_index(size)).fill_null(0).to_numpy()
            ends = total + np.cumsum(sizes)
            own = [pa.array(np.full(len(sizes), part), pa.int32()), pa.array(np.arange(n, n + len(sizes))), pa.array(ends - sizes)]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*b.schema.names, "part", index, begin])
            n += len(sizes)
            total = int(ends[-1]) if len(sizes) else total

    rows = settled(ranged.mapInArrow(run, T.StructType([*ranged.schema.fields, *added])), "ranged")
    before = _before(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("sum")), ["n", "sum"])
    rows = rows.join(F.broadcast(before), "part")  # one row for each partition
    return rows.withColumns({index: F.col(index) + F.col("n"), begin: F.col(begin) + F.col("sum")}).drop("part", "n", "sum")


def _ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` in sorted range partitions; a row number breaks ties, so that equal keys spread too."""
    order = [F.col(k).asc_nulls_first() for k in [*keys, "tie"]]
    rows = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(width(df.sparkSession), *order)
    return rows.sortWithinPartitions(*order).drop("tie")


def _before(totals: DataFrame, names: list[str]) -> DataFrame:
    """(part, *names): each partition's sums over the partitions before it."""
    offsets, so_far = [], dict.fromkeys(names, 0)
    for row in totals.orderBy("part").collect():
        offsets.append((row["part"], *so_far.values()))
        so_far = {k: so_far[k] + (row[k] or 0) for k in names}
    return totals.sparkSession.createDataFrame(offsets, "part int, " + ", ".join(f"{k} long" for k in names))


def with_row_ids(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(rid, doc_id, text) of ``documents()``, and whether rid is doc_id.

    rid identifies a document and orders documents by doc_id.  Where doc_ids are unique
    and not null it is doc_id itself.  Else documents are numbered by (doc_id with nulls
    first, hash of the text); repeated rows share one rid and so count as one document.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn("rid", F.col("doc_id")), True
    docs = docs.withColumn("hash", F.xxhash64("text"))
    ids = settled(ordered_index(docs.select("doc_id", "hash").distinct(), ["doc_id", "hash"]), "rids")
    ids = ids.select(F.col("index").alias("rid"), F.col("doc_id").alias("id"), F.col("hash").alias("h"))
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h"))).drop("id", "h", "hash"), False


def for_each_row(result: DataFrame, own: DataFrame, unique: bool) -> DataFrame:
    """A result by rid, given back for each row of ``with_row_ids``, by doc_id and with the columns kept.

    A kept column that is named as one of the result gets ``_`` behind its name.
    """
    if "rest" in own.columns:
        taken = {c.lower() for c in ("rid", "doc_id", *result.columns)}
        kept = []
        for k, c in enumerate(own.schema["rest"].dataType.names):
            while c.lower() in taken:
                c += "_"
            taken.add(c.lower())
            kept.append(F.col("rest").getField(own.schema["rest"].dataType.names[k]).alias(c))
        return own.select("rid", "doc_id", *kept).join(result, "rid").drop("rid")
    if unique:
        return result.withColumnRenamed("rid", "doc_id")
    return own.select("rid", "doc_id").join(result, "rid").drop("rid")
