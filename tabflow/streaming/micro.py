"""Running chains over tables that grow.

The step language knows no event time: a chain over a stream means the chain over the
rows that arrived, batch by batch (rows do not depend on each other), or a grouped
result that is kept up to date.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.aggregates import Aggregator, over_groups
from ..functions.compiler import compile_formula
from ..operators.dataset import Dataset
from ..operators.steps import Calculate, Chain, ExplodeHorizontally, ExplodeVertically, Filter, FilterSet, MoveColumns, RemoveColumns, Rename, Run, Search, SelectColumns

#: Steps that look at one row at a time: they mean the same over a stream as over a table.
ROW_STEPS = (Filter, FilterSet, Search, Calculate, SelectColumns, RemoveColumns, MoveColumns, Rename, ExplodeVertically, ExplodeHorizontally)


def row_steps(stream: DataFrame, chain: Chain) -> DataFrame:
    """The stream after a chain of row steps; ValueError for others."""
    run, table = Run(stream.sparkSession), Dataset(stream)
    for s in chain.fused():
        if not isinstance(s, ROW_STEPS):
            raise ValueError(f"{s.kind} needs the whole table")
        table = s.apply(table, run)
    return table.df


def each_batch(stream: DataFrame, chain: Chain, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Any chain over each batch of rows that arrived, handed to ``sink`` with the batch's number.

    A batch may come again after a failure, with the same number: a sink that replaces
    what it wrote for that number makes the whole exactly-once.
    """

    def run(batch: DataFrame, number: int) -> None:
        steps = Run(batch.sparkSession)
        table = Dataset(batch)
        for s in chain.fused():
            table = s.apply(table, steps)
        sink(table.df, number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_groups(stream: DataFrame, groups: dict[str, str], values: dict[str, Aggregator], event_time: str | None = None, window: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """A grouped result kept over the stream; with an event time, by tumbling windows closed ``delay`` late."""
    if event_time and window:
        stream = stream.withWatermark(event_time, delay)
    helped, aggregates = over_groups(values, stream)
    keys = [compile_formula(f, helped).column().alias(n) for n, f in groups.items()]
    if event_time and window:
        keys.insert(0, F.window(event_time, window).alias("window"))
    return helped.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def growing(spark: SparkSession, table: Dataset, size: int = 256) -> Iterator[Dataset]:
    """The table's rows so far, again and again as more of them are ready: for showing results early."""
    rows: list = []
    for batch in table.batches(size):
        rows += batch
        yield table._with(spark.createDataFrame(rows, table.df.schema))
