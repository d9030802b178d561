"""Values of the formula language as Spark columns.

A value is *empty* (null) or *invalid* (the result of an error) or neither.  Invalid
travels in a column of its own, beside the value, and becomes null when a value is
written to a table.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds a value may have, by Spark type.
DOUBLE, LONG, BOOL, TEXT, TIME, BYTES, LIST, JSON, NONE = "double", "long", "bool", "string", "time", "bytes", "list", "json", "none"
EPOCH_2001 = 978_307_200


@dataclass(frozen=True)
class Val:
    """A column, the column that says whether it is invalid (None: never), and its kind.

    ``item`` is the kind of a list's items; ``parts`` holds a list's items where they
    are known one by one.  A null in ``value`` that is not invalid is empty; with
    ``nulls``, every null is invalid and every invalid null.  ``raw`` is a table's own
    column where ``value`` is computed from it: conditions on it reach the scan.
    """

    value: Column
    invalid: Column | None
    kind: str
    item: str = TEXT
    parts: tuple[Val, ...] | None = None
    constant: object = None
    nulls: bool = False
    raw: Column | None = None

    @property
    def flag(self) -> Column:
        return F.lit(False) if self.invalid is None else self.invalid

    def column(self) -> Column:
        """What a table holds: null for invalid."""
        return self.value if self.invalid is None or self.nulls else F.when(~self.invalid, self.value)


def kind_of(data_type: T.DataType) -> tuple[str, str]:
    """(kind, kind of items) of a Spark type."""
    match data_type:
        case T.BooleanType():
            return BOOL, TEXT
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return LONG, TEXT
        case T.FractionalType():
            return DOUBLE, TEXT
        case T.TimestampType() | T.TimestampNTZType() | T.DateType():
            return TIME, TEXT
        case T.BinaryType():
            return BYTES, TEXT
        case T.ArrayType():
            return LIST, kind_of(data_type.elementType)[0]
        case T.VariantType():
            return JSON, TEXT
        case T.NullType():
            return NONE, TEXT
    return TEXT, TEXT


def from_column(column: Column, data_type: T.DataType) -> Val:
    """A table's column: never invalid.  Numbers become long or double, times get the zone UTC."""
    kind, item = kind_of(data_type)
    raw = column if isinstance(data_type, T.TimestampNTZType) else None
    match kind:
        case "double":
            column = column.cast("double")
        case "long":
            column = column.cast("long")
        case "time" if not isinstance(data_type, T.TimestampType):
            column = utc(column)
        case "none":
            column = column.cast("string")
        case "string" if not isinstance(data_type, T.StringType):
            column = column.cast("string")
    return Val(column, None, kind, item, raw=raw)


def utc(column: Column) -> Column:
    """A timestamp without a zone, or a date, as an instant in UTC whatever the session's zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column.cast("timestamp_ntz")))


def without_zone(x: Val) -> Column:
    """A time as the clock in UTC shows it, without a zone: the table's own column if it is one."""
    if x.raw is not None:
        return x.raw
    return F.timestamp_add("MICROSECOND", F.unix_micros(x.column()), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def constant(value: object) -> Val:
    """A literal; None is empty."""
    match value:
        case None:
            return Val(F.lit(None).cast("string"), None, NONE)
        case bool():
            return Val(F.lit(value), None, BOOL, constant=value)
        case int() if -(1 << 63) <= value < 1 << 63:
            return Val(F.lit(value).cast("long"), None, LONG, constant=value)
        case int() | float():
            return Val(F.lit(float(value)), None, DOUBLE, constant=float(value))
        case bytes():
            return Val(F.lit(bytearray(value)), None, BYTES, constant=value)
        case datetime() | date():
            return Val(F.timestamp_seconds(F.lit(value.timestamp())), None, TIME)
    return Val(F.lit(str(value)), None, TEXT, constant=value)



def invalid() -> Val:
    return Val(F.lit(None).cast("string"), F.lit(True), NONE)


def need(value: Column, kind: str, item: str = TEXT) -> Val:
    """A result for which null means invalid: what a function gives that lacks an argument."""
    return Val(value, value.isNull(), kind, item, nulls=True)


def number(x: Val) -> Column:
    """The value as double; null if it has none, as empty, invalid, dates, bytes and lists do."""
    match x.kind:
        case "double":
            out = x.value
        case "long":
            out = x.value.cast("double")
        case "bool":
            out = x.value.cast("double")
        case "string":
            # Leading white space makes no number, though a cast would take it.
            out = F.when(~x.value.rlike(r"^\s"), x.value.try_cast("double"))
            out = F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)
        case _:
            return F.lit(None).cast("double")
    return out if x.invalid is None or x.nulls else F.when(~x.invalid, out)


def integer(x: Val) -> Column:
    """The value as long: doubles are cut off."""
    match x.kind:
        case "long":
            out = x.value
        case "bool":
            out = x.value.cast("long")
        case "double":
            out = F.when(F.abs(x.value) < 2.0**63, x.value).try_cast("long")
        case "string":
            out = F.when(x.value.rlike(r"^[+-]?[0-9]+$"), x.value.try_cast("long"))
        case _:
            return F.lit(None).cast("long")
    return out if x.invalid is None or x.nulls else F.when(~x.invalid, out)


def truth(x: Val) -> Column:
    """The value as boolean: 1 is true; doubles have none."""
    match x.kind:
        case "bool":
            out = x.value
        case "long" | "string":
            out = integer(x) == 1
        case _:
            return F.lit(None).cast("boolean")
    return out if x.invalid is None or x.nulls else F.when(~x.invalid, out)


def iso(time: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ in UTC, by arithmetic and so in any session zone."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def text(x: Val, strict: bool = False) -> Column:
    """The value as text; doubles as Spark writes them, or with six decimals if ``strict``."""
    match x.kind:
        case "string":
            out = x.value
        case "long":
            out = x.value.cast("string")
        case "bool":
            out = F.when(x.value, "1").when(~x.value, "0")
        case "double":
            out = F.when(x.value.isNotNull(), F.format_string("%f", x.value)) if strict else x.value.cast("string")
        case "time":
            out = iso(x.value)
        case "json":
            out = F.try_variant_get(x.value, "$", "string")
        case _:
            return F.lit(None).cast("string")
    return out if x.invalid is None or x.nulls else F.when(~x.invalid, out)


def time(x: Val) -> Column:
    """The value as timestamp, if it is one."""
    if x.kind != TIME:
        return F.lit(None).cast("timestamp")
    return x.column()


def either(*flags: Column | None) -> Column | None:
    """Whether any flag is set; None if none can be."""
    found = [f for f in flags if f is not None]
    out = None
    for f in found:
        out = f if out is None else out | f
    return out


def common_kind(values: list[Val]) -> str:
    """The kind that all can be given in: their own, double for numbers, else text."""
    kinds = {v.kind for v in values if v.kind != NONE}
    if len(kinds) <= 1:
        return kinds.pop() if kinds else TEXT
    return DOUBLE if kinds <= {DOUBLE, LONG} else TEXT


def as_kind(x: Val, kind: str, strict: bool = False) -> Column:
    """The value's column in another kind, null where it has none."""
    if x.kind == kind:
        return x.column()
    match kind:
        case "double":
            return number(x)
        case "long":
            return integer(x)
        case "bool":
            return truth(x)
        case "time":
            return time(x)
        case "string":
            return text(x, strict)
        case "bytes":
            return F.lit(None).cast("binary")
    return F.lit(None)
