"""Operators on the pieces of cells: exploding, dummies, search, sets of values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.compiler import quoted, split_literal, unpack_items
from .dataset import Dataset
from .names import new_name

#: Ways to cut a cell into pieces.
LINES = {"crlf": "\r\n", "lf": "\n", "cr": "\r"}


def pieces(table: Dataset, column: str, mode: str, separator: str = ",") -> Column:
    """A cell's pieces as an array: mode list, pack, separator, crlf, lf or cr."""
    own = table._own([column])[0]
    x = v.from_column(table.df[quoted(own)], table.df.schema[own].dataType)
    if mode == "list":
        return x.value if x.kind == v.LIST else F.array(x.value)
    if mode == "pack":
        return unpack_items(v.text(x))
    return split_literal(F.when(v.text(x) != "", v.text(x)), F.lit(LINES.get(mode, separator)))


def explode_down(table: Dataset, column: str, mode: str = "separator", separator: str = ",") -> Dataset:
    """One row for each piece of a cell; a row without pieces goes."""
    own = table._own([column])[0]
    return table._with(table.df.withColumn(own, F.explode(pieces(table, own, mode, separator))))


def explode_across(table: Dataset, column: str, targets: Sequence[str] | None = None, mode: str = "separator", separator: str = ",") -> Dataset:
    """Pieces to columns (c_0, c_1, c_2 unless named); pieces beyond them go, missing ones are empty."""
    own = table._own([column])[0]
    names = list(targets) if targets is not None else [f"{own}_{k}" for k in range(3)]
    array = pieces(table, own, mode, separator)
    out = table.df.withColumns({n: F.try_element_at(array, F.lit(k + 1)) for k, n in enumerate(names)})
    return table._with(out if own in names else out.drop(own))


def dummies(table: Dataset, column: str, most: int = 1_000) -> Dataset:
    """A boolean column ``column_value`` for each distinct value, in their order; at most ``most`` values."""
    own = table._own([column])[0]
    found = [r[0] for r in table.df.select(quoted(own)).distinct().orderBy(F.col(quoted(own)).asc_nulls_first()).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{own} has over {most} values")
    names: dict[str, Column] = {}
    for x in found:
        names[new_name(f"{own}_{'' if x is None else x}", [*table.columns, *names])] = F.col(quoted(own)).eqNullSafe(F.lit(x))
    return table._with(table.df.withColumns(names))


def search(table: Dataset, query: str) -> Dataset:
    """Rows with the text, in any case, in any cell; an empty query keeps all."""
    if not query:
        return table
    cells = (v.text(v.from_column(table.df[quoted(f.name)], f.dataType)) for f in table.df.schema)
    return table._with(table.df.filter(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False)) for c in cells))))


def filter_set(table: Dataset, allowed: Mapping[str, Sequence[object]], inverse: bool = False) -> Dataset:
    """Rows whose cells are among the values given for each column; ``inverse``: among none of them, by column.

    No values allow no row.  None stands for empty cells.
    """
    df = table.df
    for name, values in allowed.items():
        own = table._own([name])[0]
        some = [x for x in values if x is not None]
        inside = F.coalesce(F.col(quoted(own)).isin(some), F.lit(False)) if some else F.lit(False)
        if None in values:
            inside = inside | F.col(quoted(own)).isNull()
        df = df.filter(~inside if inverse else inside)
    return table._with(df)


def move_columns(table: Dataset, names: Sequence[str], before: str | None = None) -> Dataset:
    """Columns moved in front of another, or to the end."""
    moved = table._own(names)
    rest = [c for c in table.columns if c not in moved]
    at = rest.index(table._own([before])[0]) if before and table._own([before]) and table._own([before])[0] in rest else len(rest)
    return table.select([*rest[:at], *moved, *rest[at:]])


def column_profile(table: Dataset, column: str) -> Dataset:
    """One row about a column, in one pass: average, deviation, extremes, counts of cells, values and empties."""
    own = table._own([column])[0]
    x = v.from_column(table.df[quoted(own)], table.df.schema[own].dataType)
    n = v.number(x)
    extreme = x.value if x.kind in (v.LONG, v.TEXT, v.TIME) else n
    return table._with(table.df.agg(F.avg(n).alias("average"), F.stddev_samp(n).alias("stdev"), F.min(extreme).alias("minimum"), F.max(extreme).alias("maximum"), F.count(F.lit(1)).alias("cells"), F.count_distinct(x.value).alias("distinct"), F.count_if(x.value.isNull()).alias("empty")))


def frequencies(table: Dataset, column: str, pattern: str | None = None) -> Dataset:
    """How often each value of a column occurs; only values that a pattern finds, if one is given."""
    own = table._own([column])[0]
    out = table.df
    if pattern:
        out = out.filter(v.text(v.from_column(out[quoted(own)], out.schema[own].dataType)).rlike(pattern))
    return table._with(out.groupBy(F.col(quoted(own)).alias("value")).agg(F.count(F.lit(1)).alias("count")))


def chart_data(table: Dataset, **formulas: str) -> Dataset:
    """What a chart or a map draws: columns x and y, or latitude, longitude and so on, by formula."""
    return table._with(table.df.select(*(table._value(f).column().alias(n) for n, f in formulas.items())))


def dissect(path: Sequence[str | int], column: str) -> str:
    """The formula for the value at a path of keys and (0-based) places in a JSON column."""
    out = f"FROM.JSON([{column}])"
    for step in path:
        out += f"[{step + 1}]" if isinstance(step, int) else '->"' + step.replace('"', '""') + '"'
    return out
