"""Reducers: aggregates of a formula over rows, grouped or running."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from . import values as v
from .compiler import compile_formula, pack_items
from .formula import FormulaError, Node
from .values import Val

#: Reducers that a running frame computes only from the list of values so far.
LISTED = {"median", "medianLow", "medianHigh", "medianPack", "countDistinct"}


@dataclass(frozen=True)
class Aggregator:
    """Reduce the values of ``formula`` by the function with id ``reducer``.

    ``minimum_count``: the result is empty where fewer values are there (so that small
    groups stay hidden).  ``order`` names columns that order concat, pack and list,
    whose results depend on it.  ``strict``: an empty value makes sum and average
    invalid, and min and max compare numbers only.
    """

    formula: str | Node
    reducer: str
    minimum_count: int | None = None
    order: tuple[str, ...] = ()
    strict: bool = False

    def running(self, df: DataFrame, over: WindowSpec, language: str = "en") -> Column:
        """The reducer's result so far, over a window's frame."""
        x = compile_formula(self.formula, df, language=language, strict=self.strict)
        run = lambda c: c.over(over)
        out = running(self.reducer, x, run, self.strict) if self.reducer in LISTED else reduced(self.reducer, x, run, self.order, self.strict)
        if self.minimum_count is not None:
            out = F.when(run(F.count(x.column())) >= self.minimum_count, out)
        return out


def reduced(name: str, x: Val, run, order: tuple[str, ...], strict: bool, helper: str | None = None) -> Column:
    """The aggregate; ``run`` puts it over a window if there is one; ``helper`` names a column of the numbers."""
    number, whole = v.number(x), x.kind == v.LONG
    own = x.column() if whole else number
    poison = (lambda c: F.when(run(F.count_if(number.isNull())) == 0, c)) if strict else (lambda c: c)
    match name:
        case "sum":
            return poison(run(F.sum(number)))
        case "average":
            return poison(run(F.avg(number)))
        case "min" | "max":
            f = F.min if name == "min" else F.max
            return run(f(x.column() if not strict and x.kind in (v.TEXT, v.TIME) else own))
        case "count":
            return run(F.count(number))
        case "countAll":
            return run(F.count(F.lit(1)))
        case "countDistinct":
            return run(F.count_distinct(x.column()))
        case "median":
            return run(F.median(number))
        case "medianLow":
            return disc(helper, False)
        case "medianHigh":
            return disc(helper, True)
        case "medianPack":
            low, high = (v.text(Val(disc(helper, h), None, v.DOUBLE), strict) for h in (False, True))
            return F.when(F.count(number) % 2 == 0, pack_items(F.array(low, high))).otherwise(pack_items(F.array(low)))
        case "variancePopulation":
            return run(F.var_pop(number))
        case "varianceSample":
            return run(F.var_samp(number))
        case "stdevPopulation":
            return run(F.stddev_pop(number))
        case "stdevSample":
            return run(F.stddev_samp(number))
        case "concat" | "pack" | "list":
            # Items carry their order and are sorted after collecting: a list drops no empties this way.
            item = x.column() if name == "list" else v.text(x, strict)
            rows = run(F.collect_list(F.struct(*(F.col(c) for c in order), item.alias("item"))))
            items = F.transform(F.array_sort(rows) if order else rows, lambda r: r["item"])
            if name == "list":
                return items
            return F.array_join(F.transform(items, lambda s: F.coalesce(s, F.lit(""))), "") if name == "concat" else pack_items(items)
    raise FormulaError(f"{name} does not reduce rows")


def disc(helper: str, high: bool) -> Column:
    """The lower or upper middle value of a helper column: the exact discrete percentile from either end."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{helper}`{' DESC' if high else ''})")


def over_groups(aggregators: dict[str, Aggregator], df: DataFrame, language: str = "en") -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with the helper columns that some reducers need, and the aggregate columns by name."""
    helpers: dict[str, Column] = {}
    out: dict[str, Column] = {}
    for name, a in aggregators.items():
        x = compile_formula(a.formula, df, language=language, strict=a.strict)
        helper = f"__middle{len(helpers)}" if a.reducer in ("medianLow", "medianHigh", "medianPack") else None
        if helper:
            helpers[helper] = v.number(x)
        column = reduced(a.reducer, x, lambda c: c, a.order, a.strict, helper)
        if a.minimum_count is not None:
            column = F.when(F.count(x.column()) >= a.minimum_count, column)
        out[name] = column
    return (df.withColumns(helpers) if helpers else df), out


def running(name: str, x: Val, run, strict: bool) -> Column:
    """Middles and distinct counts over a growing frame: from the sorted list of its values."""
    if name == "countDistinct":
        return F.size(run(F.collect_set(x.column()))).cast("long")
    a = F.array_sort(run(F.collect_list(v.number(x))))
    n = F.size(a)
    pick = lambda k: F.try_element_at(a, F.when(n > 0, k.cast("int")))
    low, high = pick(F.floor((n + 1) / 2)), pick(F.floor(n / 2) + 1)
    match name:
        case "medianLow":
            return low
        case "medianHigh":
            return high
        case "median":
            return (low + high) / 2
    texts = [v.text(Val(c, None, v.DOUBLE), strict) for c in (low, high)]
    return F.when(n % 2 == 0, pack_items(F.array(*texts))).otherwise(pack_items(F.array(texts[0])))
