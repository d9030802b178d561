"""The table algebra: a lazy table and its operators, each a plain DataFrame plan."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values as v
from ..functions.aggregates import Aggregator, over_groups
from ..functions.compiler import Context, compile_condition, compile_formula, compile_node, conjuncts, context, quoted
from ..functions.formula import FormulaError, Node, columns_of, parse
from .kept import kept
from .names import default_name, new_name

#: Bytes of the smaller side of a join without equalities that is sent to all tasks; a larger one is not.
SENT_BYTES = 64 << 20
#: Columns that a pivot or a transposition may make.
MOST_COLUMNS = 10_000


@dataclass(frozen=True)
class Order:
    """A sort key: a formula, its direction, and whether it sorts as numbers or as texts."""

    formula: str | Node
    ascending: bool = True
    numeric: bool = True

    def column(self, df: DataFrame, language: str = "en") -> Column:
        x = compile_formula(self.formula, df, language=language)
        key = (x.column() if x.kind in (v.LONG, v.TIME) else v.number(x)) if self.numeric else v.text(x)
        return key.asc_nulls_first() if self.ascending else key.desc_nulls_last()


@dataclass(frozen=True)
class Join:
    """How to join another table: its formula may name ``[own]`` and ``#[other]`` columns; type left or inner."""

    other: Dataset
    formula: str | Node
    type: str = "left"
    nulls_match: bool = False


class Dataset:
    """A table under construction.  Every operator returns a new one; nothing runs before an action."""

    def __init__(self, df: DataFrame, language: str = "en", strict: bool = False):
        self.df, self.language, self.strict = df, language, strict

    def _with(self, df: DataFrame) -> Dataset:
        return Dataset(df, self.language, self.strict)

    def _tree(self, formula: str | Node) -> Node:
        return parse(formula, self.language) if isinstance(formula, str) else formula

    def _value(self, formula: str | Node) -> v.Val:
        return compile_formula(formula, self.df, language=self.language, strict=self.strict)

    def _own(self, names: Sequence[str]) -> list[str]:
        """The table's own spelling of the names it has, in the order asked."""
        known = {c.lower(): c for c in self.df.columns}
        return list(dict.fromkeys(known[n.lower()] for n in names if n.lower() in known))

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    # rows

    def filter(self, formula: str | Node) -> Dataset:
        """Rows for which the formula is true: TRUE, 1 or "1"; empty and invalid are not.

        Conditions that ANDs join are filters of their own, so each can reach the scan.
        """
        df = self.df
        for part in conjuncts(self._tree(formula)):
            df = df.filter(compile_condition(part, context(df, strict=self.strict)))
        return self._with(df)

    def limit(self, n: int) -> Dataset:
        return self._with(self.df.limit(n))

    def offset(self, n: int) -> Dataset:
        return self._with(self.df.offset(n))

    def random(self, n: int, seed: int | None = None) -> Dataset:
        """Exactly n rows (or all, if fewer), each set as likely: a partial top-n by random keys."""
        key = new_name("__random", self.columns)
        return self._with(self.df.withColumn(key, F.rand(seed)).orderBy(key).limit(n).drop(key))

    def distinct(self) -> Dataset:
        return self._with(self.df.distinct())

    def unique(self, formula: str | Node, column: str = "value") -> Dataset:
        """The distinct values of a formula."""
        return self._with(self.df.select(self._value(formula).column().alias(column)).distinct())

    def sort(self, orders: Sequence[Order]) -> Dataset:
        return self._with(self.df.orderBy(*(o.column(self.df, self.language) for o in orders))) if orders else self

    def union(self, other: Dataset) -> Dataset:
        """All rows of both, columns matched by name; what a side lacks is empty.

        Columns of one name but unlike types are texts.
        """
        left, right = self.df, other.df
        types = {f.name.lower(): f.dataType for f in right.schema}
        clash = {f.name for f in left.schema if f.name.lower() in types and not alike(f.dataType, types[f.name.lower()])}
        low = {c.lower() for c in clash}
        as_text = lambda df, names: df.withColumns({c: v.text(v.from_column(df[quoted(c)], df.schema[c].dataType)) for c in names}) if names else df
        return self._with(as_text(left, sorted(clash)).unionByName(as_text(right, [c for c in right.columns if c.lower() in low]), allowMissingColumns=True))

    # columns

    def select(self, names: Sequence[str]) -> Dataset:
        """The columns named, in that order; unknown names are passed over."""
        return self._with(self.df.select(*(quoted(c) for c in self._own(names))))

    def calculate(self, formulas: Mapping[str, str | Node]) -> Dataset:
        """Sets or appends columns, all from the row as it was; ``@`` is the column's own old value."""
        known = {c.lower(): c for c in self.columns}
        base = context(self.df, strict=self.strict)
        out = {}
        for name, formula in formulas.items():
            tree = self._tree(formula)
            if columns_of(tree, True):
                raise FormulaError("a calculation knows no joined columns")
            ctx = Context(base.columns, current=base.columns.get(name.lower()), strict=self.strict)
            out[known.get(name.lower(), name)] = compile_node(tree, ctx).column()
        return self._with(self.df.withColumns(out))

    def rename(self, names: Mapping[str, str]) -> Dataset:
        """New names for columns; one that another column already has drops the later column."""
        new = {k.lower(): x for k, x in names.items()}
        seen: set[str] = set()
        kept = []
        for c in self.columns:
            name = new.get(c.lower(), c)
            if name.lower() not in seen:
                seen.add(name.lower())
                kept.append(self.df[quoted(c)].alias(name))
        return self._with(self.df.select(*kept))

    # groups

    def aggregate(self, groups: Mapping[str, str | Node], values: Mapping[str, Aggregator]) -> Dataset:
        """One row for each combination of the group formulas, or one in all without groups."""
        helped, aggregates = over_groups(dict(values), self.df, self.language)
        keys = [compile_formula(f, helped, language=self.language, strict=self.strict).column().alias(n) for n, f in groups.items()]
        columns = [c.alias(n) for n, c in aggregates.items()]
        if not columns:
            return self._with(helped.select(*keys).distinct())
        return self._with(helped.groupBy(*keys).agg(*columns))

    def pivot(self, horizontal: Sequence[str], vertical: Sequence[str], values: Sequence[str]) -> Dataset:
        """Spreads already grouped rows: a column for each combination of horizontal cells and value column.

        Combinations differ where any cell does, empty and "" too.  A column's name joins the
        cells and the value column's name by ``_``, with a letter behind it where two would be
        alike; of several rows for one cell, the last counts.  The combinations are listed
        first (at most MOST_COLUMNS), so that their order is the same in every run.
        """
        across, down, cells = self._own(horizontal), self._own(vertical), self._own(values)
        if not across:
            return self
        texts = [self._text(c) for c in across]
        # Texts behind their lengths: no two combinations have the same key.
        key = F.concat(*(F.coalesce(F.concat(F.char_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts))
        label = F.concat(*(x for c in texts for x in (F.coalesce(c, F.lit("")), F.lit("_"))))
        name, place = new_name("__key", self.columns), new_name("__place", self.columns)
        rows = self.df.withColumns({name: key, place: F.monotonically_increasing_id()})
        found = self.df.select(key.alias("key"), label.alias("label")).distinct().orderBy("label", "key").limit(MOST_COLUMNS + 1).collect()
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"a pivot would make over {MOST_COLUMNS} columns")
        # Conditional aggregates rather than a two-step pivot: one shuffle, partly aggregated first.
        used = list(down)
        columns = []
        for x in found:
            for c in cells:
                column = new_name(x["label"] + c, used)
                used.append(column)
                columns.append(F.max_by(F.col(quoted(c)), F.when(F.col(name) == x["key"], F.col(place))).alias(column))
        grouped = rows.groupBy(*(quoted(c) for c in down))
        return self._with(grouped.agg(*columns) if columns else self.df.select(*(quoted(c) for c in down)).distinct())

    def _text(self, column: str) -> Column:
        return v.text(v.from_column(self.df[quoted(column)], self.df.schema[column].dataType), self.strict)

    def flatten(self, value_to: str, name_to: str | None = None, row_id: str | Node | None = None, row_id_to: str | None = None) -> Dataset:
        """One row for each cell: (row id, column name, value); cells of unlike types are texts."""
        df = self.df
        base = [compile_formula(row_id, df, language=self.language).column().alias(row_id_to or "row")] if row_id is not None else []
        types = {f.dataType for f in df.schema}
        cells = [df[quoted(c)] if len(types) == 1 else self._text(c) for c in df.columns]
        rows = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), x.alias("value")) for c, x in zip(df.columns, cells, strict=True)))) if cells else None
        if rows is None:
            return self
        out = df.select(*base, rows.alias("__cell"))
        names = [F.col("__cell.name").alias(name_to)] if name_to else []
        return self._with(out.select(*([F.col(quoted(row_id_to or "row"))] if base else []), *names, F.col("__cell.value").alias(value_to)))

    def transpose(self, most: int = 1_000) -> Dataset:
        """Rows become columns: the first column's cells name them, the first new column holds the old names.

        A result has a column for each row, so this is for small tables: over ``most``
        rows it refuses.  Cells are texts unless all columns behind the first have one type.
        """
        df, spark = self.df, self.df.sparkSession
        if not df.columns:
            return self
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a table of over {most} rows is not transposed")
        types = {f.dataType for f in df.schema.fields[1:]}
        kind = types.pop() if len(types) == 1 else None
        names = [default_name(0)]
        for r in rows:
            names.append(new_name(str(r[0]) if r[0] is not None else default_name(len(names)), names))
        body = [[c, *(r[k] if kind is not None or r[k] is None else str(r[k]) for r in rows)] for k, c in enumerate(df.columns) if k]
        schema = ", ".join([f"{quoted(names[0])} string", *(f"{quoted(n)} {kind.simpleString() if kind is not None else 'string'}" for n in names[1:])])
        return self._with(spark.createDataFrame(body, schema))

    def rank(self, values: Mapping[str, Aggregator], by: Sequence[Order]) -> Dataset:
        """Running aggregates: each row gets the result over itself and all rows sorted before it.

        Sums, counts, averages, minima and maxima are computed in two passes: within
        sorted range partitions, and over the partitions' totals.  Other reducers need
        all earlier rows at once and go through one window without partitions.
        """
        from .running import TWO_PASS, running_table

        if by and all(a.reducer in TWO_PASS and not a.strict and a.minimum_count is None for a in values.values()):
            return self._with(running_table(self, values, by))
        w = Window.orderBy(*(o.column(self.df, self.language) for o in by)).rowsBetween(Window.unboundedPreceding, 0) if by else Window.orderBy(F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, 0)
        return self._with(self.df.withColumns({n: a.running(self.df, w, self.language) for n, a in values.items()}))

    # two tables

    def join(self, join: Join) -> Dataset:
        """Left or inner join on a formula.  The result has the left columns and those of the right that are new.

        If the right table has no new column, the left one is returned as it is.
        Equalities between the sides become join keys, which Catalyst shuffles or sends as
        sizes tell.  A join without any sends the right side only if it is small; a larger one
        is joined block by block, and for a left join the rows that met none are added.
        """
        if join.type not in ("left", "inner"):
            raise ValueError(f"no join type {join.type}")
        left, right = self.df, join.other.df
        mine = {c.lower() for c in left.columns}
        new = [c for c in right.columns if c.lower() not in mine]
        if not new:
            return self
        tree = self._tree(join.formula)
        used = {c.lower() for c in columns_of(tree, True)}
        # Right columns get names of their own, so that clashes cannot happen.
        alias = {c: f"__right{k}" for k, c in enumerate(right.columns) if c in new or c.lower() in used}
        other = right.select(*(right[quoted(c)].alias(a) for c, a in alias.items()))
        ctx = context(left, strict=self.strict or join.nulls_match)
        ctx.foreign = {c.lower(): v.from_column(other[a], right.schema[c].dataType) for c, a in alias.items()}
        condition = reduce(lambda a, b: a & b, (compile_condition(c, ctx) for c in conjuncts(tree)), F.lit(True))
        columns = [*(left[quoted(c)] for c in left.columns), *(other[alias[c]].alias(c) for c in new)]
        if equi(tree) or join.type == "inner" or is_small(other):
            return self._with(left.join(F.broadcast(other) if not equi(tree) and is_small(other) else other, condition, join.type).select(*columns))
        # Spark would send the right side of a left join without keys, however large: rows that
        # meet some are found by an inner join, the others by their cells.
        met = left.join(other, condition, "inner").select(*columns)
        mine_met = met.select(*(F.col(quoted(c)).alias(f"__met{k}") for k, c in enumerate(left.columns))).distinct()
        same = reduce(lambda a, b: a & b, (left[quoted(c)].eqNullSafe(F.col(f"__met{k}")) for k, c in enumerate(left.columns)), F.lit(True))
        alone = left.join(mine_met, same, "left_anti")
        return self._with(met.unionByName(alone, allowMissingColumns=True))

    # results

    def histogram(self, formula: str | Node, value: str = "value", count: str = "count") -> Dataset:
        """How often each value of a formula occurs."""
        return self._with(self.df.groupBy(self._value(formula).column().alias(value)).agg(F.count(F.lit(1)).alias(count)))

    def rows(self) -> list[Row]:
        return self.df.collect()

    def batches(self, size: int = 256) -> Iterator[list[Row]]:
        """Rows as they are ready, in batches; a partition is fetched while another is read.

        All rows come to the driver: for a table of any size, ``numbered`` leaves them with the tasks.
        """
        held: list[Row] = []
        for row in self.df.toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held


    def numbered(self, size: int = 256, name: str = "batch") -> Dataset:
        """Each row with the number of its batch, from 0: all batches have ``size`` rows, the last one at most that.

        Batches follow the order of rows and partitions, as those of ``batches`` do, and go on from
        one partition into the next: totals of the partitions before tell each row its place.
        """
        if size < 1:
            raise ValueError("a batch has at least one row")
        df = self.df
        place, part, n, before = (new_name(x, [*df.columns, name]) for x in ("__place", "__part", "__n", "__before"))
        rows = kept(df.withColumn(place, F.monotonically_increasing_id()))  # the same places serve totals and rows
        own = F.shiftright(place, 33)  # Spark puts the partition above the 33 bits of the place in it
        totals = rows.groupBy(own.alias(part)).agg(F.count(F.lit(1)).alias(n))
        earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select(part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
        at = F.col(before) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
        batch = F.call_function("div", at, F.lit(size)).alias(name)
        return self._with(rows.join(F.broadcast(starts), own == F.col(part)).select(*(rows[quoted(c)] for c in df.columns if c.lower() != name.lower()), batch))


def alike(a, b) -> bool:
    return a == b or v.kind_of(a)[0] == v.kind_of(b)[0] != v.TEXT and v.kind_of(a)[0] in (v.LONG, v.DOUBLE, v.TIME)


def equi(tree: Node) -> bool:
    """Whether a condition has an equality between an own and a joined side, alone or ANDed with others."""
    from ..functions.formula import Binary, Call

    match tree:
        case Binary("=", a, b):
            return any(not columns_of(x, True) and columns_of(x) and not columns_of(y) and columns_of(y, True) for x, y in ((a, b), (b, a)))
        case Call("and", args):
            return any(map(equi, args))
    return False


def is_small(df: DataFrame) -> bool:
    """Whether the optimizer's own estimate of the table's size allows to send it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SENT_BYTES


def union_all(parts: Sequence[Dataset]) -> Dataset:
    return reduce(Dataset.union, parts)
