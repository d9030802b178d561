"""Running aggregates over a whole table without moving it to one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values as v
from ..functions.aggregates import Aggregator
from ..functions.compiler import compile_formula
from .kept import kept
from .names import new_name

if TYPE_CHECKING:
    from .dataset import Dataset, Order

TWO_PASS = {"sum", "average", "count", "countAll", "min", "max"}


def running_table(table: Dataset, values: Mapping[str, Aggregator], by: Sequence[Order]) -> DataFrame:
    """Sorted by ``by``, with a running result for each aggregator; output sorted.

    Rows are range-partitioned by the keys with a tie-breaker.  Each partition's totals
    go through one window over as many rows as there are partitions; within partitions
    the frame grows from their start; the totals before are added.
    """
    df, spark = table.df, table.df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = list(df.columns)

    def name(x: str) -> str:
        taken.append(new_name(x, taken))
        return taken[-1]

    tie, part = name("__tie"), name("__part")
    keys = [name(f"__key{k}") for k in range(len(by))]
    inputs = {out: name(f"__in{k}") for k, out in enumerate(values)}
    columns = {tie: F.monotonically_increasing_id()}
    for key, o in zip(keys, by, strict=True):
        x = compile_formula(o.formula, df, language=table.language)
        columns[key] = (x.column() if x.kind in (v.LONG, v.TIME) else v.number(x)) if o.numeric else v.text(x)
    for out, a in values.items():
        x = compile_formula(a.formula, df, language=table.language)
        columns[inputs[out]] = x.column() if a.reducer in ("min", "max") and x.kind in (v.LONG, v.TEXT, v.TIME) else v.number(x)
    order = [F.col(k).asc_nulls_first() if o.ascending else F.col(k).desc_nulls_last() for k, o in zip(keys, by, strict=True)] + [F.col(tie)]
    # One exchange by range; the number of the partition is then a key that keeps rows where they are together.
    ranged = df.withColumns(columns).repartitionByRange(n, *order).withColumn(part, F.spark_partition_id())
    ranged = kept(ranged)  # the same partitions serve totals and rows

    def states(a: Aggregator, c: str) -> dict[str, object]:
        match a.reducer:
            case "sum":
                return {"s": F.sum(c)}
            case "average":
                return {"s": F.sum(c), "n": F.count(c)}
            case "count":
                return {"n": F.count(c)}
            case "countAll":
                return {"n": F.count(F.lit(1))}
            case "min":
                return {"m": F.min(c)}
        return {"m": F.max(c)}

    merge = {"s": F.sum, "n": F.sum}
    every = [(out, a, s, column) for out, a in values.items() for s, column in states(a, inputs[out]).items()]
    totals = ranged.groupBy(part).agg(*(column.alias(f"{inputs[out]}{s}") for out, _, s, column in every))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    fold = lambda a, s: merge.get(s) or (F.min if a.reducer == "min" else F.max)
    before = totals.select(F.col(part).alias("__at"), *(fold(a, s)(f"{inputs[out]}{s}").over(earlier).alias(f"__before{inputs[out]}{s}") for out, a, s, _ in every))
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(before), F.col(part) == F.col("__at"))
    results = {}
    for out, a in values.items():
        got = {}
        for s, column in states(a, inputs[out]).items():
            old, new = F.col(f"__before{inputs[out]}{s}"), column.over(w)
            got[s] = F.coalesce(old + new, new, old) if s in ("s", "n") else F.least(old, new) if a.reducer == "min" else F.greatest(old, new)
        results[out] = F.try_divide(got["s"], got["n"]) if a.reducer == "average" else next(iter(got.values()))
    return joined.withColumns(results).select(*(df.columns), *(c for c in values if c not in df.columns))
