"""Pipelines: chains of steps that can be saved, previewed and run in full."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any, ClassVar

from pyspark.sql import SparkSession

from ..functions.aggregates import Aggregator
from ..functions.formula import Binary, Call, Literal, parse, to_formula
from . import pieces
from .dataset import Dataset, Join, Order
from .kept import kept
from .names import new_name

KINDS: dict[str, type[Step]] = {}


@dataclass(frozen=True)
class Run:
    """What a run of steps needs: the session, other chains by name, whether rows are a preview's."""

    spark: SparkSession
    chains: Mapping[str, Chain] = field(default_factory=dict)
    preview_rows: int | None = None


class Step:
    """One step; ``apply`` gives the table after it."""

    kind: ClassVar[str]
    #: Names of the chains that the step reads.
    reads: ClassVar[tuple[str, ...]] = ()

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        cls.kind = cls.__name__
        KINDS[cls.kind] = cls

    def apply(self, table: Dataset | None, run: Run) -> Dataset:
        raise NotImplementedError

    def after(self, before: Step) -> Step | None:
        """One step that does what ``before`` and then this does, if there is one."""
        return None

    def chains(self) -> list[str]:
        return [getattr(self, r) for r in self.reads]


def step(cls):
    return dataclass(frozen=True)(cls)


# rows


@step
class Filter(Step):
    formula: str

    def apply(self, table, run):
        return table.filter(self.formula)

    def after(self, before):
        if isinstance(before, Filter):
            return Filter(to_formula(Call("and", (parse(before.formula), parse(self.formula)))))
        return None


@step
class FilterSet(Step):
    allowed: dict[str, list]
    inverse: bool = False

    def apply(self, table, run):
        return pieces.filter_set(table, self.allowed, self.inverse)


@step
class Search(Step):
    query: str

    def apply(self, table, run):
        return pieces.search(table, self.query)


@step
class Limit(Step):
    rows: int

    def apply(self, table, run):
        return table.limit(self.rows)

    def after(self, before):
        return Limit(min(before.rows, self.rows)) if isinstance(before, Limit) else None


@step
class Offset(Step):
    rows: int

    def apply(self, table, run):
        return table.offset(self.rows)

    def after(self, before):
        return Offset(before.rows + self.rows) if isinstance(before, Offset) else None


@step
class RandomRows(Step):
    rows: int
    seed: int | None = None

    def apply(self, table, run):
        return table.random(self.rows, self.seed)


@step
class Distinct(Step):
    def apply(self, table, run):
        return table.distinct()

    def after(self, before):
        return self if isinstance(before, Distinct) else None


@step
class Sort(Step):
    orders: list[dict]

    def apply(self, table, run):
        return table.sort([Order(**o) for o in self.orders])

    def after(self, before):
        return self if isinstance(before, Sort) else None


# columns


@step
class Calculate(Step):
    """A column by formula, placed before or after another if named, else where it was or last."""

    column: str
    formula: str
    before: str | None = None
    behind: str | None = None

    def apply(self, table, run):
        known = bool(table._own([self.column]))
        out = table.calculate({self.column: self.formula})
        if known or not (self.before or self.behind):
            return out
        if self.before:
            return pieces.move_columns(out, [self.column], self.before)
        names = table.columns
        at = names.index(table._own([self.behind])[0]) + 1 if table._own([self.behind]) else len(names)
        return pieces.move_columns(out, [self.column], names[at] if at < len(names) else None)


@step
class SelectColumns(Step):
    """The columns named, in the order they already have."""

    columns: list[str]

    def apply(self, table, run):
        wanted = {c.lower() for c in self.columns}
        return table.select([c for c in table.columns if c.lower() in wanted])

    def after(self, before):
        if isinstance(before, SelectColumns):
            wanted = {c.lower() for c in before.columns}
            return SelectColumns([c for c in self.columns if c.lower() in wanted])
        return None


@step
class RemoveColumns(Step):
    columns: list[str]

    def apply(self, table, run):
        gone = {c.lower() for c in self.columns}
        return table.select([c for c in table.columns if c.lower() not in gone])

    def after(self, before):
        return RemoveColumns([*before.columns, *self.columns]) if isinstance(before, RemoveColumns) else None


@step
class MoveColumns(Step):
    columns: list[str]
    before: str | None = None

    def apply(self, table, run):
        return pieces.move_columns(table, self.columns, self.before)


@step
class Rename(Step):
    names: dict[str, str]

    def apply(self, table, run):
        return table.rename(self.names)


# shape


@step
class Rank(Step):
    """Sorts, and writes a running result: the row's number, or a reducer of a formula."""

    target: str
    orders: list[dict]
    reducer: str = "countAll"
    formula: str = "1"

    def apply(self, table, run):
        return table.rank({self.target: Aggregator(self.formula, self.reducer)}, [Order(**o) for o in self.orders])


@step
class Pivot(Step):
    """Groups by rows and columns and spreads the columns; without columns, groups only.

    values: name -> {"formula", "reducer", "minimum_count"}.
    """

    rows: list[str]
    columns: list[str]
    values: dict[str, dict]

    def apply(self, table, run):
        groups = {c: f"[{c}]" for c in table._own([*self.rows, *self.columns])}
        taken = list(groups)
        values = {}
        for name, a in self.values.items():
            values[new_name(name, taken)] = Aggregator(**a)
            taken.append(name)
        return table.aggregate(groups, values).pivot(self.columns, self.rows, list(values))


@step
class Flatten(Step):
    """One row for each cell; the row id is the first column unless a formula is given."""

    value_to: str
    name_to: str | None = None
    row_id: str | None = None
    row_id_to: str | None = None

    def apply(self, table, run):
        row_id = self.row_id or (f"[{table.columns[0]}]" if self.row_id_to and table.columns else None)
        return table.flatten(self.value_to, self.name_to, row_id, self.row_id_to)


@step
class Transpose(Step):
    def apply(self, table, run):
        return table.transpose()


@step
class ExplodeVertically(Step):
    column: str
    mode: str = "separator"
    separator: str = ","

    def apply(self, table, run):
        return pieces.explode_down(table, self.column, self.mode, self.separator)


@step
class ExplodeHorizontally(Step):
    column: str
    targets: list[str] | None = None
    mode: str = "separator"
    separator: str = ","

    def apply(self, table, run):
        return pieces.explode_across(table, self.column, self.targets, self.mode, self.separator)


@step
class Dummies(Step):
    column: str

    def apply(self, table, run):
        return pieces.dummies(table, self.column)


# other chains


@step
class JoinChain(Step):
    chain: str
    formula: str
    type: str = "left"
    reads = ("chain",)

    def apply(self, table, run):
        return table.join(Join(run.chains[self.chain].table(run), self.formula, self.type))


@step
class Merge(Step):
    """All rows of this and of another chain."""

    chain: str
    reads = ("chain",)

    def apply(self, table, run):
        return table.union(run.chains[self.chain].table(run))


@step
class Clone(Step):
    """Begins with another chain's result."""

    chain: str
    reads = ("chain",)

    def apply(self, table, run):
        return run.chains[self.chain].table(run)


# sources and side effects


@step
class Source(Step):
    """Begins with a file, database table or generated table: see ``sources.registry.read``."""

    format: str
    options: dict[str, Any] = field(default_factory=dict)

    def apply(self, table, run):
        from ..sources.registry import read

        return Dataset(read(run.spark, self.format, **self.options))


@step
class Rows(Step):
    """Begins with a table written out: its columns and rows."""

    schema: str
    rows: list[list]

    def apply(self, table, run):
        return Dataset(run.spark.createDataFrame([tuple(r) for r in self.rows], self.schema))


@step
class Crawl(Step):
    """Fetches a URL for each row: see ``sources.crawl.crawl``."""

    url: str
    options: dict[str, Any] = field(default_factory=dict)

    def apply(self, table, run):
        from ..sources.crawl import crawl

        return crawl(table, self.url, **self.options)


@step
class Cache(Step):
    """Keeps the table so far, in memory and on disk, for what follows, until ``kept.release()``."""

    def apply(self, table, run):
        return table._with(kept(table.df))


@step
class Export(Step):
    """Writes the table on the way and passes it on; a preview writes nothing."""

    format: str
    path: str
    options: dict[str, Any] = field(default_factory=dict)

    def apply(self, table, run):
        from ..sources.registry import write

        if run.preview_rows is None:
            write(table.df, self.format, self.path, **self.options)
        return table


@step
class Debug(Step):
    """Does nothing, or computes the table and keeps it (``materialize``), or waits (``delay``: seconds)."""

    effect: str = "none"
    delay: float = 0.0

    def apply(self, table, run):
        if self.effect == "materialize":
            table = table._with(kept(table.df))
            table.df.count()
        elif self.effect == "delay":
            import time

            time.sleep(self.delay)
        return table


class Chain:
    """A named row of steps, the first of which is a source or a clone."""

    def __init__(self, steps: list[Step]):
        self.steps = steps

    def needs(self) -> list[str]:
        return [name for s in self.steps for name in s.chains()]

    def fused(self) -> list[Step]:
        """The steps, with neighbours that one step can replace put together."""
        out: list[Step] = []
        for s in self.steps:
            one = s.after(out[-1]) if out else None
            if one is not None:
                out[-1] = one
            else:
                out.append(s)
        return out

    def table(self, run: Run) -> Dataset:
        table = None
        for s in self.fused():
            table = s.apply(table, run)
            if run.preview_rows is not None and table is not None and isinstance(s, (Source, Rows)):
                table = table.limit(run.preview_rows)
        if table is None:
            raise ValueError("a chain without steps has no table")
        return table


class Workspace:
    """Chains that may read each other."""

    def __init__(self, chains: Mapping[str, Chain]):
        self.chains = dict(chains)
        self.check()

    def check(self) -> None:
        """ValueError where chains depend on themselves or on a chain that is not there."""
        state: dict[str, str] = {}

        def visit(name: str) -> None:
            if state.get(name) == "open":
                raise ValueError(f"chain {name} depends on itself")
            if name not in self.chains:
                raise ValueError(f"there is no chain {name}")
            if name not in state:
                state[name] = "open"
                for other in self.chains[name].needs():
                    visit(other)
                state[name] = "done"

        for name in self.chains:
            visit(name)

    def full(self, spark: SparkSession, name: str) -> Dataset:
        """The whole result of a chain."""
        return self.chains[name].table(Run(spark, self.chains))

    def preview(self, spark: SparkSession, name: str, rows: int = 500, source_rows: int = 25_000) -> Dataset:
        """A result from the first rows of each source: quick, and not the full answer."""
        return self.chains[name].table(Run(spark, self.chains, source_rows)).limit(rows)

    def to_json(self) -> str:
        return json.dumps({name: [{"step": s.kind, **asdict(s)} for s in c.steps] for name, c in self.chains.items()}, indent=1)

    @staticmethod
    def from_json(text: str) -> Workspace:
        def make(data: dict) -> Step:
            cls = KINDS[data["step"]]
            known = {f.name for f in fields(cls)}
            return cls(**{k: x for k, x in data.items() if k in known})

        return Workspace({name: Chain([make(s) for s in steps]) for name, steps in json.loads(text).items()})


def suggest_filters(row: Mapping[str, object]) -> list[Step]:
    """Steps that keep rows like one that was picked: equality with each of its cells."""
    return [Filter(to_formula(Binary("=", parse(f"[{c}]"), Literal(x)))) for c, x in row.items() if x is None or isinstance(x, (str, int, float, bool))]


