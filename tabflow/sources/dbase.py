"""dBase III files (DBF): a reader and a writer as Spark data sources."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as v
from ..functions.compiler import quoted

HEADER = struct.Struct("<BBBBIHH20x")
FIELD = struct.Struct("<11sc4xBB14x")
WIDTH = 255


def parse_header(data: bytes) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """(records, header's length, record's length, fields: name, type, length, decimals)."""
    _, _, _, _, n, head, size = HEADER.unpack(data[: HEADER.size])
    fields, at = [], HEADER.size
    while at + FIELD.size <= head and data[at] != 0x0D:
        name, kind, length, decimals = FIELD.unpack(data[at : at + FIELD.size])
        fields.append((name.split(b"\0")[0].decode("latin-1"), kind.decode("latin-1"), length, decimals))
        at += FIELD.size
    return n, head, size, fields


def spark_type(kind: str, length: int, decimals: int) -> T.DataType:
    if kind in "NF":
        return T.LongType() if kind == "N" and not decimals and length <= 18 else T.DoubleType()
    return T.BooleanType() if kind == "L" else T.StringType()


def cell(raw: bytes, kind: T.DataType, encoding: str) -> object:
    text = raw.decode(encoding, "replace").strip(" \0")
    if not text or set(text) == {"*"}:
        return None
    match kind:
        case T.LongType():
            try:
                return int(text)
            except ValueError:
                return None
        case T.DoubleType():
            try:
                return float(text)
            except ValueError:
                return None
        case T.BooleanType():
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return text


def read_dbf(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """A DBF file's records; deleted ones are passed over, blank cells are empty.

    The file is read by Spark (any store it knows), the records are cut in the task that
    holds the file: a DBF file is at most some GB and has one header.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    head = files.select(F.substring("content", 1, 65_536).alias("head")).limit(1).collect()
    if not head:
        return spark.createDataFrame([], T.StructType([]))
    fields = parse_header(bytes(head[0]["head"]))[3]
    schema = T.StructType([T.StructField(n, spark_type(k, size, d)) for n, k, size, d in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(1):
                own = data.as_py()
                n, begin, size, columns = parse_header(own)
                kinds = [spark_type(k, length, d) for _, k, length, d in columns]
                for lo in range(0, n, 10_000):
                    rows: list[list[object]] = [[] for _ in columns]
                    for r in range(lo, min(n, lo + 10_000)):
                        record = own[begin + r * size : begin + (r + 1) * size]
                        if len(record) < size or record[:1] == b"*":
                            continue
                        at = 1
                        for out, (_, _, length, _), kind in zip(rows, columns, kinds, strict=True):
                            out.append(cell(record[at : at + length], kind, encoding))
                            at += length
                    arrow = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}
                    yield pa.RecordBatch.from_arrays([pa.array(x, arrow[k]) for x, k in zip(rows, kinds, strict=True)], names=[c[0] for c in columns])

    return files.mapInArrow(run, schema)


def dbf_bytes(names: list[str], rows: list[tuple[str | None, ...]], encoding: str = "utf-8") -> bytes:
    """A DBF file with text columns of 255 bytes; longer cells are cut at a character."""
    out = io.BytesIO()
    today = date.today()
    out.write(HEADER.pack(3, today.year - 1900, today.month, today.day, len(rows), HEADER.size + FIELD.size * len(names) + 1, 1 + WIDTH * len(names)))
    for n in names:
        out.write(FIELD.pack(n.encode(encoding)[:10], b"C", WIDTH, 0))
    out.write(b"\r")
    for row in rows:
        out.write(b" ")
        for x in row:
            raw = (x or "").encode(encoding)[:WIDTH].decode(encoding, "ignore").encode(encoding)
            out.write(raw.ljust(WIDTH))
    out.write(b"\x1a")
    return out.getvalue()


def write_dbf(df: DataFrame, path: str, mode: str = "overwrite", most: int = 1_000_000) -> None:
    """One DBF file at a local path, written by the driver row by row; over ``most`` rows it refuses."""
    import os

    if mode == "error" and os.path.exists(path):
        raise FileExistsError(path)
    texts = df.select(*(v.text(v.from_column(df[quoted(f.name)], f.dataType)).alias(f.name) for f in df.schema))
    rows = [tuple(r) for r in texts.limit(most + 1).toLocalIterator()]
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    with open(path, "wb") as f:
        f.write(dbf_bytes(df.columns, rows))
