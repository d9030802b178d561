"""File sources and sinks: CSV, JSON, whole texts, XML; Parquet and ORC as Spark has them."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as v
from ..functions.compiler import quoted
from ..operators.names import default_name, new_name


def read_csv(spark: SparkSession, path: str, separator: str = ";", header: bool = True, decimal: str = ".", grouping: str = "", infer: bool = True, encoding: str = "UTF-8", quoted_lines: bool | None = None) -> DataFrame:
    """A CSV file; quoted fields may hold separators and line ends.

    A file whose quoted fields hold line ends is read by one task, others are cut among
    many: ``quoted_lines`` tells, or a pass over the lines finds out.

    Short rows are filled up with empties, long ones cut.  Repeated header names get a
    letter; without a header, columns are A, B, C.  All cells are read as texts in one
    pass; with ``infer`` a second pass finds columns whose cells are all whole numbers
    or all numbers (in the locale's signs).
    """
    if quoted_lines is None:
        # A field that goes on in the next line leaves an odd number of quotes in this one.
        quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
        quoted_lines = encoding.upper() not in ("UTF-8", "US-ASCII", "ISO-8859-1") or not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()
    options = {"sep": separator, "quote": '"', "escape": '"', "multiLine": quoted_lines, "encoding": encoding, "mode": "PERMISSIVE", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    first = spark.read.options(**options, header=False, inferSchema=False).csv(path).limit(1).collect()
    if not first:
        return spark.createDataFrame([], T.StructType([]))
    names: list[str] = []
    for k, cell in enumerate(first[0]):
        names.append(new_name(cell if header and cell else default_name(k), names))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.options(**options, header=header, enforceSchema=True).schema(schema).csv(path)
    return typed(rows, decimal, grouping) if infer else rows


def typed(df: DataFrame, decimal: str = ".", grouping: str = "") -> DataFrame:
    """Text columns whose cells are all whole numbers or all numbers get that type; one pass over all columns."""
    plain = {c: F.replace(F.replace(F.col(quoted(c)), F.lit(grouping), F.lit("")) if grouping else F.col(quoted(c)), F.lit(decimal), F.lit(".")) for c in df.columns}
    tests: list[Column] = []
    for c in df.columns:
        some = F.col(quoted(c)).isNotNull()
        whole = plain[c].rlike(r"^[+-]?[0-9]+$") & plain[c].try_cast("long").isNotNull()
        tests += [F.every(~some | whole), F.every(~some | v.number(v.Val(plain[c], None, v.TEXT)).isNotNull()), F.count(F.when(some, 1))]
    if not tests:
        return df
    found = df.agg(*tests).first()
    out = []
    for k, c in enumerate(df.columns):
        whole, number, n = found[3 * k : 3 * k + 3]
        out.append((plain[c].try_cast("long") if whole and n else plain[c].try_cast("double") if number and n else F.col(quoted(c))).alias(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, separator: str = ";", header: bool = True, mode: str = "overwrite") -> None:
    df.select(*(v.text(v.from_column(df[quoted(f.name)], f.dataType)).alias(f.name) for f in df.schema)).write.mode(mode).options(sep=separator, header=header, quote='"', escape='"', lineSep="\n").csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file: an array of objects gives the first one's keys as columns, an array of values the column
    ``items``, anything else the column ``data``.

    The head of the file is looked at on the driver; the rows are parsed by Spark.
    """
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.try_parse_json("value").alias("data"))
    kind = parsed.select(F.schema_of_variant("data")).first()[0]
    if not kind or not kind.startswith("ARRAY"):
        return parsed
    items = whole.select(F.explode(F.from_json("value", "array<string>")).alias("item"))
    first = items.limit(1).collect()
    try:
        head = json.loads(first[0][0]) if first else None
    except ValueError:
        head = None
    if not isinstance(head, dict):
        return items.withColumnRenamed("item", "items")
    kinds = {bool: "boolean", int: "bigint", float: "double"}
    member = lambda k: F.try_variant_get(F.try_parse_json("item"), "$['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']", kinds.get(type(head[k]), "string"))
    return items.select(*(member(k).alias(k) for k in head))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_text(spark: SparkSession, path: str, column: str = "Data") -> DataFrame:
    """Each file whole, one row, one column."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", column)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def escaped(text: Column) -> Column:
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def write_xml(df: DataFrame, path: str, title: str = "", mode: str = "overwrite") -> None:
    """Files that are each a ``<graph>`` with the table's rows as ``<grid>`` of ``<row>`` and ``<cell>``.

    Rows become lines of XML in the tasks; each task's file is a document of its own.
    """
    cells = [F.concat(F.lit("<cell>"), escaped(F.coalesce(v.text(v.from_column(df[quoted(f.name)], f.dataType)), F.lit(""))), F.lit("</cell>")) for f in df.schema]
    rows = df.select(F.concat(F.lit("<row>"), *cells, F.lit("</row>")).alias("value"))
    from xml.sax.saxutils import escape

    names = "".join(f"<cell>{escape(c)}</cell>" for c in df.columns)
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<graph><title>{escape(title)}</title><grid>\n<row>{names}</row>'

    def document(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": [head]})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])  # without Spark's note that no value is null
        yield pa.RecordBatch.from_pydict({"value": ["</grid></graph>"]})

    rows.mapInArrow(document, "value string").write.mode(mode).text(path)
