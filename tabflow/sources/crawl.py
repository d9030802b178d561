"""HTTP: one address, or one for each row."""

from __future__ import annotations

import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import values as v
from ..operators.dataset import Dataset
from ..operators.names import new_name

#: A fetcher gives (status, body) or raises.
Fetcher = Callable[[str], tuple[int, str]]


def fetch(url: str, timeout: float = 30.0) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.status or 200, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def read_http(spark: SparkSession, url: str, column: str = "Data", fetcher: Fetcher = fetch) -> DataFrame:
    """One row with what an address returns; empty if it fails."""
    try:
        body = fetcher(url)[1]
    except Exception:
        body = None
    return spark.createDataFrame([(body,)], T.StructType([T.StructField(column, T.StringType())]))


class Pace:
    """At most ``per_second`` starts a second, shared by threads."""

    def __init__(self, per_second: float):
        self.gap, self.next, self.lock = 1 / per_second, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        time.sleep(max(0.0, at - now))


def crawl(table: Dataset, url: str, body: str | None = "body", status: str | None = None, error: str | None = None, seconds: str | None = None, concurrent: int = 50, per_second: float = 256.0, fetcher: Fetcher = fetch) -> Dataset:
    """Fetches a URL (a formula) for each row and adds the columns that are named.

    A row whose fetch fails gets an empty body and the error's text; none is lost.  Each
    task keeps to its own share: ``concurrent`` requests at once, ``per_second`` started.
    """
    df = table.df
    address = new_name("__url", df.columns)
    rows = df.withColumn(address, v.text(table._value(url)))
    added = [(body, T.StringType(), pa.string(), 0), (status, T.LongType(), pa.int64(), 1), (error, T.StringType(), pa.string(), 2), (seconds, T.DoubleType(), pa.float64(), 3)]
    added = [x for x in added if x[0]]
    names = {x[0].lower() for x in added}
    kept = [c for c in df.columns if c.lower() not in names]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, t) for n, t, _, _ in added)])

    def one(pace: Pace, target: str | None) -> tuple:
        if target is None:
            return None, None, "no address", None
        pace.wait()
        began = time.monotonic()
        try:
            code, text = fetcher(target)
            return text, code, None, time.monotonic() - began
        except Exception as e:  # whatever a fetch raises is that row's error
            return None, None, str(e) or type(e).__name__, time.monotonic() - began

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(per_second)
        with ThreadPoolExecutor(concurrent) as pool:
            for b in batches:
                found = list(pool.map(lambda t: one(pace, t), b.column(b.num_columns - 1).to_pylist()))
                columns = [b.column(b.schema.get_field_index(c)) for c in kept]
                columns += [pa.array([f[k] for f in found], kind) for _, _, kind, k in added]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return table._with(rows.mapInArrow(run, schema))
