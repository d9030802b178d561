"""Readers and writers by format, and formats by file ending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.sequencer import range_table, sequence_table
from . import crawl, databases, dbase, files

READERS = {
    "csv": files.read_csv, "json": files.read_json, "text": files.read_text, "parquet": files.read_parquet, "orc": files.read_orc,
    "dbf": dbase.read_dbf, "sqlite": databases.read_sqlite, "jdbc": databases.read_jdbc, "http": crawl.read_http,
    "sequence": sequence_table, "range": range_table,
}
WRITERS = {"csv": files.write_csv, "json": files.write_json, "xml": files.write_xml, "dbf": dbase.write_dbf, "sqlite": databases.write_sqlite, "jdbc": databases.write_jdbc}
ENDINGS = {"csv": "csv", "tsv": "csv", "tab": "csv", "txt": "csv", "json": "json", "dbf": "dbf", "sqlite": "sqlite", "sqlite3": "sqlite", "db": "sqlite", "xml": "xml", "parquet": "parquet", "orc": "orc"}


def format_of(path: str) -> str:
    """The format that a path's ending stands for."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in ENDINGS:
        raise ValueError(f"no format is known for {path}")
    return ENDINGS[ending]


def read(spark: SparkSession, format: str, **options) -> DataFrame:
    return READERS[format](spark, **options)


def open_file(spark: SparkSession, path: str, **options) -> DataFrame:
    return read(spark, format_of(path), path=path, **options)


def write(df: DataFrame, format: str, path: str, **options) -> None:
    if format in ("parquet", "orc"):
        df.write.mode(options.pop("mode", "overwrite")).format(format).save(path)
    else:
        WRITERS[format](df, path, **options)
