"""Stored tables that can be changed: each change writes the table anew and then takes its place."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compiler import quoted


class Table:
    """A Parquet table in a folder, with versions: a change writes the next version and points to it.

    ``key`` names the columns that identify a row; ``computed`` ones refuse updates.
    Readers of an old version are not disturbed; ``vacuum`` removes old versions.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = (), computed: Sequence[str] = ()):
        self.spark, self.path, self.key, self.computed = spark, path.rstrip("/"), tuple(key), {c.lower() for c in computed}

    @staticmethod
    def create(df: DataFrame, path: str, key: Sequence[str] = ()) -> Table:
        table = Table(df.sparkSession, path, key)
        table._write(df)
        return table

    def _fs(self):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(path(self.path)) if s.getPath().getName().startswith("v"))

    def _write(self, df: DataFrame) -> None:
        """The next version appears under its name only when it is whole."""
        fs, path = self._fs()
        found = self._versions()
        number = int(found[-1][1:]) + 1 if found else 0
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        df.write.parquet(draft)
        if not fs.rename(path(draft), path(f"{self.path}/v{number:012d}")):
            raise OSError(f"another change of {self.path} came first")

    def read(self) -> DataFrame:
        found = self._versions()
        if not found:
            raise ValueError(f"no table at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{found[-1]}")

    def vacuum(self) -> None:
        fs, path = self._fs()
        for old in self._versions()[:-1]:
            fs.delete(path(f"{self.path}/{old}"), True)

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)

    def truncate(self) -> None:
        self._write(self.read().limit(0))

    def insert(self, row: Mapping[str, object] | Row) -> None:
        """Adds one row; unknown columns are dropped, missing ones are empty."""
        schema = self.read().schema
        given = {k.lower(): x for k, x in (row.asDict() if isinstance(row, Row) else row).items()}
        one = self.spark.createDataFrame([tuple(given.get(f.name.lower()) for f in schema)], T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
        self._write(self.read().unionByName(one))

    def import_rows(self, df: DataFrame, mapping: Mapping[str, str]) -> None:
        """Appends rows; ``mapping`` names the source column for each of the table's, others are empty."""
        own = self.read()
        source = {k.lower(): x for k, x in mapping.items()}
        known = {c.lower(): c for c in df.columns}
        cells = []
        for f in own.schema:
            c = known.get(source.get(f.name.lower(), "").lower())
            cells.append((F.col(quoted(c)).try_cast(f.dataType) if c else F.lit(None).cast(f.dataType)).alias(f.name))
        self._write(own.unionByName(df.select(*cells)))

    def alter(self, columns: Mapping[str, str]) -> None:
        """Makes the table have these columns (name: type): others go, new ones are empty."""
        own = self.read()
        known = {c.lower(): c for c in own.columns}
        self._write(own.select(*((F.col(quoted(known[n.lower()])) if n.lower() in known else F.lit(None).cast(t)).alias(n) for n, t in columns.items())))

    def rename(self, names: Mapping[str, str]) -> None:
        self._write(self.read().withColumnsRenamed(dict(names)))

    def update(self, key: Mapping[str, object], column: str, old: object, new: object) -> None:
        """Sets a cell of the rows with this key, where it still holds ``old``."""
        if column.lower() in self.computed:
            raise ValueError(f"{column} is computed")
        own = self.read()
        here = F.col(quoted(column)).eqNullSafe(F.lit(old))
        for k, x in key.items():
            here = here & F.col(quoted(k)).eqNullSafe(F.lit(x))
        self._write(own.withColumn(column, F.when(here, F.lit(new).cast(own.schema[column].dataType)).otherwise(F.col(quoted(column)))))

    def delete(self, keys: Sequence[Mapping[str, object]]) -> None:
        """Removes the rows that have any of these keys."""
        own = self.read()
        gone = F.lit(False)
        for key in keys:
            here = F.lit(True)
            for k, x in key.items():
                here = here & F.col(quoted(k)).eqNullSafe(F.lit(x))
            gone = gone | here
        self._write(own.filter(~gone))
