"""Formula trees to Spark columns: the functions and the binary operators.

Everything is built from Spark's own functions; no formula runs Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as v
from .formula import Binary, Call, Column_, Current, FormulaError, Literal, Node, Timestamp, parse
from .language import ERROR
from .values import BOOL, BYTES, DOUBLE, JSON, LIST, LONG, NONE, TEXT, TIME, Val, need

ANY = None
ARITY: dict[str, tuple[int, int | None]] = {}
FUNCTIONS: dict[str, Callable[..., Val]] = {}


@dataclass
class Context:
    """Where names are looked up: the row's columns, the joined row's, the current cell."""

    columns: dict[str, Val]
    foreign: dict[str, Val] = field(default_factory=dict)
    current: Val | None = None
    strict: bool = False
    time_zone: str = "UTC"


def function(name: str, low: int, high: int | None = -1):
    """Register a function under its id; ``high`` None is any number, by default ``low``."""

    def add(f):
        ARITY[name] = (low, low if high == -1 else high)
        FUNCTIONS[name] = f
        return f

    return add


def context(df: DataFrame, foreign: DataFrame | None = None, **options) -> Context:
    """The columns of a frame, by lower-case name."""
    own = {f.name.lower(): v.from_column(df[quoted(f.name)], f.dataType) for f in df.schema}
    other = {f.name.lower(): v.from_column(foreign[quoted(f.name)], f.dataType) for f in foreign.schema} if foreign is not None else {}
    return Context(own, other, **options)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def compile_node(node: Node, ctx: Context) -> Val:
    """The value of a tree; FormulaError where it names a column that is not there."""
    match node:
        case Literal(value):
            return v.invalid() if value is ERROR else v.constant(value)
        case Timestamp(seconds):
            return Val(F.timestamp_micros(F.lit(round((seconds + v.EPOCH_2001) * 1_000_000)).cast("long")), None, TIME)
        case Current():
            return ctx.current or v.invalid()
        case Column_(name, foreign):
            known = ctx.foreign if foreign else ctx.columns
            if name.lower() not in known:
                raise FormulaError(f"no column {'#' * foreign}[{name}]")
            return known[name.lower()]
        case Call(name, args):
            return FUNCTIONS[name](ctx, *(compile_node(a, ctx) for a in args))
        case Binary(op, left, right):
            return binary(op, compile_node(left, ctx), compile_node(right, ctx), ctx)
    raise TypeError(node)


def compile_formula(formula: str | Node, df: DataFrame, foreign: DataFrame | None = None, language: str = "en", **options) -> Val:
    """A formula's value over the rows of ``df`` (joined with ``foreign``)."""
    return compile_node(parse(formula, language) if isinstance(formula, str) else formula, context(df, foreign, **options))


# --- binary operators ---------------------------------------------------------


def equality(a: Val, b: Val, strict: bool = False, condition: bool = False) -> Column:
    """a = b; null where one is empty, except that ``strict`` (and a literal NULL) tells empties apart.

    Numbers are equal as numbers, a number and a text if the text is that number; an
    invalid value equals nothing.  In a ``condition`` null is as good as false: a plain
    equality is left, which can be a join's key or reach a scan.
    """
    if condition and not strict and all(x.invalid is None or x.nulls for x in (a, b)):
        a, b = (replace(x, invalid=None) for x in (a, b))
    if a.kind == NONE or b.kind == NONE:
        out = a.value.isNull() & b.value.isNull()
    else:
        kinds = {a.kind, b.kind}
        if kinds == {TIME} and (a.raw is not None or b.raw is not None):
            x, y = v.without_zone(a), v.without_zone(b)
        elif len(kinds) == 1:
            x, y = a.value, b.value
        elif kinds <= {DOUBLE, LONG, BOOL} or kinds & {DOUBLE, LONG, BOOL} and TEXT in kinds:
            x, y = v.number(a), v.number(b)
            if TEXT in kinds:
                # A text that is no number equals no number.
                told = F.when(a.value.isNull() | b.value.isNull(), None).otherwise(F.coalesce(x == y, F.lit(False)))
                same = told if not strict else F.coalesce(told, a.value.isNull() & b.value.isNull())
                flag = v.either(a.invalid, b.invalid)
                return same if flag is None else F.when(flag, False).otherwise(same)
        else:
            x, y = v.text(a), v.text(b)
        out = x.eqNullSafe(y) if strict else x == y
    flag = v.either(a.invalid, b.invalid)
    return out if flag is None else F.when(flag, False).otherwise(out)


def compile_condition(node: Node, ctx: Context) -> Column:
    """Whether a tree is true, as a filter or join needs it: null and false are alike."""
    if isinstance(node, Binary) and node.op == "=":
        return equality(compile_node(node.left, ctx), compile_node(node.right, ctx), ctx.strict, True)
    x = compile_node(node, ctx)
    return v.truth(x) if x.kind in (BOOL, LONG, TEXT) else v.number(x) == 1


def conjuncts(node: Node) -> list[Node]:
    """The conditions that all hold where the node does: those that its ANDs join."""
    if isinstance(node, Call) and node.function == "and":
        return [c for a in node.args for c in conjuncts(a)]
    return [node]


def compare(op: str, a: Val, b: Val, strict: bool) -> Val:
    if not strict and a.kind == b.kind == TIME and (a.raw is not None or b.raw is not None):
        x, y = v.without_zone(a), v.without_zone(b)
    elif a.kind == b.kind == LONG or not strict and a.kind == b.kind and a.kind in (TEXT, TIME, BOOL):
        x, y = a.column(), b.column()
    elif not strict and {a.kind, b.kind} == {TIME, TEXT}:
        # A text beside a time is read as one.
        x, y = (z.column() if z.kind == TIME else F.try_to_timestamp(z.column()) for z in (a, b))
    else:
        x, y = v.number(a), v.number(b)
    out = {">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[op]
    return need(out, BOOL)


def binary(op: str, a: Val, b: Val, ctx: Context) -> Val:
    x, y = v.number(a), v.number(b)
    match op:
        case "+":
            return need(x + y, DOUBLE)
        case "-":
            return need(x - y, DOUBLE)
        case "*":
            return need(x * y, DOUBLE)
        case "/":
            return need(F.try_divide(x, y), DOUBLE)
        case "~":
            return need(F.try_mod(x, y), DOUBLE)
        case "^":
            return need(finite(F.pow(x, y)), DOUBLE)
        case "&":
            texts = [F.coalesce(v.text(z, ctx.strict), F.lit("")) for z in (a, b)]
            return Val(F.concat(*texts), v.either(a.invalid, b.invalid), TEXT)
        case ">" | "<" | ">=" | "<=":
            return compare(op, a, b, ctx.strict)
        case "=":
            return Val(equality(a, b, ctx.strict), None, BOOL)
        case "<>":
            return Val(~equality(a, b, ctx.strict), None, BOOL)
    s, t = v.text(a, ctx.strict), v.text(b, ctx.strict)
    match op:
        case "~=":
            return need(F.contains(F.lower(s), F.lower(t)), BOOL)
        case "~~=":
            return need(F.contains(s, t), BOOL)
        case "±=":
            return need(F.rlike(s, F.concat(F.lit("(?i)"), t)), BOOL)
        case "±±=":
            return need(F.rlike(s, t), BOOL)
    raise FormulaError(f"no operator {op}")


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


# --- logic --------------------------------------------------------------------


@function("identity", 1)
def _identity(ctx, x):
    return x


@function("and", 0, ANY)
def _and(ctx, *args):
    """False as soon as one is false (later errors are not looked at), invalid if one before is."""
    if not args:
        return v.constant(True)
    value, wrong = F.lit(True), F.lit(False)
    for x in reversed(args):
        holds = F.coalesce(v.truth(x), F.lit(False)) & ~x.flag
        value = F.when(x.flag, None).when(~holds, False).otherwise(value)
        wrong = x.flag | (holds & wrong)
    return Val(value, wrong, BOOL)


@function("or", 0, ANY)
def _or(ctx, *args):
    if not args:
        return v.constant(False)
    value = reduce(lambda p, q: p | q, (F.coalesce(v.truth(x), F.lit(False)) for x in args))
    return Val(value, v.either(*(x.invalid for x in args)), BOOL)


@function("xor", 2)
def _xor(ctx, a, b):
    return need(v.truth(a) != v.truth(b), BOOL)


@function("not", 1)
def _not(ctx, x):
    return need(~v.truth(x), BOOL)


def choice(branches: list[tuple[Column, Val]], strict: bool, otherwise: Val | None = None) -> Val:
    """The first branch whose condition holds; invalid (or ``otherwise``) if none does."""
    vals = [x for _, x in branches] + ([otherwise] if otherwise else [])
    kind = v.common_kind(vals)
    item = next((x.item for x in vals if x.kind == LIST), TEXT)
    value, flag = None, None
    for condition, x in branches:
        own = x.value if x.kind == kind else v.as_kind(x, kind, strict)
        value = F.when(condition, own) if value is None else value.when(condition, own)
        flag = F.when(condition, x.flag) if flag is None else flag.when(condition, x.flag)
    if otherwise is not None:
        value = value.otherwise(otherwise.value if otherwise.kind == kind else v.as_kind(otherwise, kind, strict))
    return Val(value, flag.otherwise(otherwise.flag if otherwise is not None else F.lit(True)), kind, item)


@function("if", 3)
def _if(ctx, condition, yes, no):
    truth = v.truth(condition)
    return choice([(truth, yes), (~truth, no)], ctx.strict)


@function("iferror", 2)
def _iferror(ctx, x, instead):
    return choice([(~x.flag, x)], ctx.strict, instead)


@function("coalesce", 0, ANY)
def _coalesce(ctx, *args):
    if not args:
        return v.constant(None)
    return choice([(~x.flag & x.value.isNotNull(), x) for x in args], ctx.strict, v.constant(None))


@function("choose", 2, ANY)
def _choose(ctx, index, *args):
    k = v.integer(index)
    return choice([(k == n, x) for n, x in enumerate(args, 1)], ctx.strict)


def among(x: Val, args: tuple[Val, ...]) -> Column:
    return reduce(lambda p, q: p | q, (F.coalesce(equality(x, y, True), F.lit(False)) for y in args))


@function("in", 2, ANY)
def _in(ctx, x, *args):
    return Val(among(x, args), None, BOOL)


@function("notIn", 2, ANY)
def _not_in(ctx, x, *args):
    return Val(~among(x, args), None, BOOL)


@function("isEmpty", 1)
def _is_empty(ctx, x):
    return Val(x.value.isNull() & ~x.flag, None, BOOL)


@function("isInvalid", 1)
def _is_invalid(ctx, x):
    return Val(x.flag, None, BOOL)


# --- numbers ------------------------------------------------------------------


def numeric(name: str, f: Callable[[Column], Column], kind: str = DOUBLE) -> None:
    ARITY[name] = (1, 1)
    FUNCTIONS[name] = lambda ctx, x: need(f(v.number(x)), kind)


numeric("negate", lambda x: -x)
numeric("abs", F.abs)
numeric("sign", lambda x: F.signum(x).cast("long"), LONG)
numeric("exp", lambda x: finite(F.exp(x)))
numeric("ln", F.ln)
numeric("floor", lambda x: F.floor(x).cast("double"))
numeric("ceiling", lambda x: F.ceil(x).cast("double"))
for _name in ("cos", "sin", "tan", "cosh", "sinh", "tanh", "acos", "asin", "atan", "sqrt"):
    numeric(_name, lambda x, f=getattr(F, _name): finite(f(x)))


@function("log", 1, 2)
def _log(ctx, x, base=None):
    return need(F.log10(v.number(x)) if base is None else finite(F.try_divide(F.ln(v.number(x)), F.ln(v.number(base)))), DOUBLE)


@function("power", 2)
def _power(ctx, x, y):
    return need(finite(F.pow(v.number(x), v.number(y))), DOUBLE)


@function("round", 1, 2)
def _round(ctx, x, decimals=None):
    """Half away from zero; a whole number without decimals."""
    n = v.number(x)
    if decimals is None or decimals.constant == 0:
        return need(F.round(n).cast("long"), LONG)
    d = v.integer(decimals)
    if isinstance(decimals.constant, (int, float)):
        return need(F.round(n, int(decimals.constant)) if decimals.constant > 0 else F.lit(None).cast("double"), DOUBLE)
    scale = F.pow(F.lit(10.0), d)
    return need(F.when(d >= 0, F.signum(n) * F.floor(F.abs(n) * scale + 0.5) / scale), DOUBLE)


@function("random", 0)
def _random(ctx):
    return Val(F.rand(), None, DOUBLE)


@function("randomBetween", 2)
def _random_between(ctx, low, high):
    a, b = v.integer(low), v.integer(high)
    return need(F.when(b > a, a + F.floor(F.rand() * (b - a + 1))), LONG)


@function("randomItem", 1, ANY)
def _random_item(ctx, *args):
    # One draw for each row: a condition by argument would draw again for each.
    kind = v.common_kind(list(args))
    array = F.array(*(F.struct(v.as_kind(x, kind, ctx.strict).alias("value"), x.flag.alias("invalid")) for x in args))
    item = F.element_at(array, (1 + F.floor(F.rand() * len(args))).cast("int"))
    return Val(F.struct(item.alias("item"))["item"]["value"], None, kind)


# The coefficients of a published rational approximation of the normal quantile.
QUANTILE_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
QUANTILE_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
QUANTILE_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
QUANTILE_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
QUANTILE_LOW = 0.02425


def polynomial(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda total, c: total * x + c, coefficients[1:], F.lit(coefficients[0]))


@function("normalInverse", 3)
def _normal_inverse(ctx, p, mean, deviation):
    """The normal distribution's quantile, in three ranges of p; invalid outside (0, 1)."""
    q = v.number(p)
    tail = lambda x: polynomial(QUANTILE_C, x) / polynomial([*QUANTILE_D, 1.0], x)
    near, far = F.sqrt(-2 * F.ln(q)), F.sqrt(-2 * F.ln(1 - q))
    r = (q - 0.5) * (q - 0.5)
    middle = (q - 0.5) * polynomial(QUANTILE_A, r) / polynomial([*QUANTILE_B, 1.0], r)
    z = F.when((q > 0) & (q < QUANTILE_LOW), tail(near)).when((q > 1 - QUANTILE_LOW) & (q < 1), -tail(far)).when((q >= QUANTILE_LOW) & (q <= 1 - QUANTILE_LOW), middle)
    return need(v.number(mean) + v.number(deviation) * z, DOUBLE)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, and not in each branch that reads it: generated code stays small enough to be compiled."""
    return F.element_at(F.transform(F.array(value), use), 1)


def power_step(n: Column, base: Column, up: bool) -> Column:
    """The power of ``base`` next above (at least base ** 1) or below n, put right by one step where logarithms err."""

    def corrected(at: Column) -> Column:
        n, base, guess = at["n"], at["base"], at["guess"]
        if up:
            out = F.when(guess < n, guess * base).when(guess / base >= n, guess / base).otherwise(guess)
            out = F.greatest(out, base)
        else:
            out = F.when(guess > n, guess / base).when(guess * base <= n, guess * base).otherwise(guess)
        return F.when(guess.isNotNull(), out).cast("long")

    def guessed(at: Column) -> Column:
        guess = F.pow(at["base"], F.rint(F.ln(at["n"]) / F.ln(at["base"])))
        return F.struct(at["n"], at["base"], F.when((at["n"] > 0) & (at["base"] > 1), guess).alias("guess"))

    return bound(bound(F.struct(n.alias("n"), base.alias("base")), guessed), corrected)


@function("powerUp", 2)
def _power_up(ctx, n, base):
    return need(power_step(v.integer(n).cast("double"), v.integer(base).cast("double"), True), LONG)


@function("powerDown", 2)
def _power_down(ctx, n, base):
    return need(power_step(v.integer(n).cast("double"), v.integer(base).cast("double"), False), LONG)


#: Levels of the largest Hilbert square: sides up to 2 ** 31.
HILBERT_LEVELS = 31


def is_side(n: Column) -> Column:
    return (n >= 2) & (n <= 1 << HILBERT_LEVELS) & (n.bitwiseAND(n - 1) == 0)


@function("hilbertXYtoD", 3)
def _hilbert_d(ctx, side, x, y):
    """Place on the Hilbert curve; ``strict`` weighs all levels alike, as older results did."""
    n, x0, y0 = v.integer(side), v.integer(x), v.integer(y)
    sides = F.transform(F.sequence(F.lit(1), F.lit(HILBERT_LEVELS)), lambda k: F.floor(n / F.pow(F.lit(2.0), k)).cast("long"))
    first = F.struct(F.lit(0).cast("long").alias("d"), x0.alias("x"), y0.alias("y"))

    def step(at: Column, s: Column) -> Column:
        rx = F.when(at["x"].bitwiseAND(s) != 0, 1).otherwise(0).cast("long")
        ry = F.when(at["y"].bitwiseAND(s) != 0, 1).otherwise(0).cast("long")
        weight = F.floor(n / 2).cast("long") * F.floor(n / 2).cast("long") if ctx.strict else s * s
        d = at["d"] + weight * (3 * rx).bitwiseXOR(ry)
        turn = ry == 0
        fx, fy = (F.when(rx == 1, s - 1 - at[c]).otherwise(at[c]) for c in ("x", "y"))
        return F.struct(d.alias("d"), F.when(turn, fy).otherwise(at["x"]).alias("x"), F.when(turn, fx).otherwise(at["y"]).alias("y"))

    inside = is_side(n) & (x0 >= 0) & (x0 < n) & (y0 >= 0) & (y0 < n)
    return need(F.when(inside, F.aggregate(F.filter(sides, lambda s: s > 0), first, step, lambda at: at["d"])), LONG)


def hilbert_place(side: Val, d: Val, axis: str) -> Val:
    n, d0 = v.integer(side), v.integer(d)
    zero = F.lit(0).cast("long")
    first = F.struct(d0.alias("t"), zero.alias("x"), zero.alias("y"))
    sides = F.transform(F.sequence(F.lit(0), F.lit(HILBERT_LEVELS - 1)), lambda k: F.pow(F.lit(2.0), k).cast("long"))

    def step(at: Column, s: Column) -> Column:
        rx = F.floor(at["t"] / 2).cast("long").bitwiseAND(F.lit(1).cast("long"))
        ry = at["t"].bitwiseXOR(rx).bitwiseAND(F.lit(1).cast("long"))
        turn = ry == 0
        fx, fy = (F.when(rx == 1, s - 1 - at[c]).otherwise(at[c]) for c in ("x", "y"))
        x, y = F.when(turn, fy).otherwise(at["x"]), F.when(turn, fx).otherwise(at["y"])
        return F.struct(F.floor(at["t"] / 4).cast("long").alias("t"), (x + s * rx).alias("x"), (y + s * ry).alias("y"))

    inside = is_side(n) & (d0 >= 0) & (d0 < n * n)
    return need(F.when(inside, F.aggregate(F.filter(sides, lambda s: s < n), first, step, lambda at: at[axis])), LONG)


@function("hilbertDtoX", 2)
def _hilbert_x(ctx, side, d):
    return hilbert_place(side, d, "x")


@function("hilbertDtoY", 2)
def _hilbert_y(ctx, side, d):
    return hilbert_place(side, d, "y")


# --- text ---------------------------------------------------------------------


def textual(name: str, f: Callable[[Column], Column], kind: str = TEXT) -> None:
    ARITY[name] = (1, 1)
    FUNCTIONS[name] = lambda ctx, x: need(f(v.text(x, ctx.strict)), kind)


textual("upper", F.upper)
textual("lower", F.lower)
textual("capitalize", F.initcap)
textual("trim", lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
textual("length", lambda s: F.char_length(s).cast("long"), LONG)

# What stays as it is in the path of a URL though a form encoder escapes it.
URL_KEPT = {"+": "%20", "%2F": "/", "%21": "!", "%24": "$", "%26": "&", "%27": "'", "%28": "(", "%29": ")", "%2B": "+", "%2C": ",", "%3A": ":", "%3D": "=", "%40": "@", "%7E": "~"}
textual("urlencode", lambda s: reduce(lambda out, kept: F.replace(out, F.lit(kept[0]), F.lit(kept[1])), URL_KEPT.items(), F.url_encode(s)))


def slice_text(x: Val, n: Val, ctx: Context, take: Callable) -> Val:
    s, k = v.text(x, ctx.strict), v.integer(n).cast("int")
    return need(F.when((k >= 0) & (k <= F.char_length(s)), take(s, k)), TEXT)


@function("left", 2)
def _left(ctx, x, n):
    return slice_text(x, n, ctx, F.left)


@function("right", 2)
def _right(ctx, x, n):
    return slice_text(x, n, ctx, F.right)


@function("mid", 3)
def _mid(ctx, x, start, n):
    """From the 0-based ``start``, cut off at the end."""
    s, a, k = v.text(x, ctx.strict), v.integer(start).cast("int"), v.integer(n).cast("int")
    return need(F.when((a >= 0) & (k >= 0) & (a <= F.char_length(s)), F.substring(s, a + 1, k)), TEXT)


@function("substitute", 3)
def _substitute(ctx, x, old, new):
    return need(F.replace(*(v.text(z, ctx.strict) for z in (x, old, new))), TEXT)


@function("regexSubstitute", 3)
def _regex_substitute(ctx, x, pattern, new):
    return need(F.regexp_replace(*(v.text(z, ctx.strict) for z in (x, pattern, new))), TEXT)


@function("levenshtein", 2)
def _levenshtein(ctx, a, b):
    return need(F.levenshtein(v.text(a, ctx.strict), v.text(b, ctx.strict)).cast("long"), LONG)


@function("parseNumber", 1, 3)
def _parse_number(ctx, x, decimal=None, thousands=None):
    s = v.text(x, ctx.strict)
    if thousands is not None:
        s = F.replace(s, v.text(thousands, ctx.strict), F.lit(""))
    if decimal is not None:
        s = F.replace(s, v.text(decimal, ctx.strict), F.lit("."))
    return need(v.number(Val(s, None, TEXT)), DOUBLE)


@function("split", 2)
def _split(ctx, x, separator):
    return need(split_literal(v.text(x, ctx.strict), v.text(separator, ctx.strict)), LIST, TEXT)


def split_literal(s: Column, separator: Column) -> Column:
    """Pieces between a literal separator, which is no pattern even where it holds ``\\E``."""
    return F.split(s, F.concat(F.lit("\\Q"), F.replace(separator, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))


@function("uuid", 0)
def _uuid(ctx):
    return Val(F.upper(F.uuid()), None, TEXT)


@function("randomString", 1)
def _random_string(ctx, pattern):
    """A random member of a constant pattern's sequence."""
    from .sequencer import Sequence

    if not isinstance(pattern.constant, str):
        raise FormulaError("RANDSTRING takes a constant pattern")
    return Val(Sequence.parse(pattern.constant).random(), None, TEXT)


# --- dates --------------------------------------------------------------------


def wall(t: Column) -> Column:
    """A timestamp whose clock in the session's zone shows the time in UTC."""
    return F.to_utc_timestamp(t, F.current_timezone())


def unwall(t: Column) -> Column:
    return F.from_utc_timestamp(t, F.current_timezone())


def seconds(t: Column) -> Column:
    return F.unix_micros(t) / 1e6


def after(t: Column, s: Column) -> Column:
    return F.timestamp_micros((F.unix_micros(t) + F.round(s * 1e6).cast("long")).cast("long"))


def from_seconds(s: Column) -> Column:
    return F.timestamp_micros(F.round(s * 1e6).cast("long"))


@function("now", 0)
def _now(ctx):
    return Val(F.current_timestamp(), None, TIME)


@function("date", 3)
def _date(ctx, year, month, day):
    """Midnight UTC; months and days beyond the calendar roll over."""
    y, m, d = (v.integer(x).cast("int") for x in (year, month, day))
    first = F.make_date(F.when((y > 0) & (y < 10_000), y), F.lit(1), F.lit(1))
    whole = F.date_add(F.add_months(first, m - 1), d - 1)
    return need(v.utc(whole), TIME)


for _name, _part in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute), ("second", F.second)):
    ARITY[_name] = (1, 1)
    FUNCTIONS[_name] = lambda ctx, x, f=_part: need(f(wall(v.time(x))).cast("long"), LONG)


@function("duration", 2)
def _duration(ctx, a, b):
    return need(seconds(v.time(b)) - seconds(v.time(a)), DOUBLE)


@function("after", 2)
def _after(ctx, t, s):
    return need(after(v.time(t), v.number(s)), TIME)


@function("toUnix", 1)
def _to_unix(ctx, t):
    return need(seconds(v.time(t)), DOUBLE)


@function("fromUnix", 1)
def _from_unix(ctx, s):
    return need(from_seconds(v.number(s)), TIME)


@function("toExcelDate", 1)
def _to_excel(ctx, t):
    return need(seconds(v.time(t)) / 86400 + 25569, DOUBLE)


@function("fromExcelDate", 1)
def _from_excel(ctx, x):
    return need(from_seconds((v.number(x) - 25569) * 86400), TIME)


@function("fromISO8601", 1)
def _from_iso(ctx, x):
    return need(F.try_to_timestamp(v.text(x), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), TIME)


@function("toUTCISO8601", 1)
def _to_iso(ctx, t):
    return need(v.iso(v.time(t)), TEXT)


@function("toLocalISO8601", 1)
def _to_local_iso(ctx, t):
    """In the language's own zone, with its offset."""
    here = wall(v.time(t))
    local = F.from_utc_timestamp(here, F.lit(ctx.time_zone))
    minutes = F.round((F.unix_micros(local) - F.unix_micros(here)) / 6e7).cast("int")
    offset = F.when(minutes == 0, "Z").otherwise(F.concat(F.when(minutes < 0, "-").otherwise("+"), F.format_string("%02d:%02d", F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60)))
    return need(F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset), TEXT)


@function("toUnicodeDateString", 2)
def _write_date(ctx, t, pattern):
    """A constant pattern is given to Spark as it is; its letters are the Unicode ones."""
    return need(F.date_format(wall(v.time(t)), date_pattern(pattern)), TEXT)


@function("fromUnicodeDateString", 2)
def _read_date(ctx, x, pattern):
    return need(unwall(F.try_to_timestamp(v.text(x), F.lit(date_pattern(pattern)))), TIME)


def date_pattern(pattern: Val) -> str:
    if not isinstance(pattern.constant, str):
        raise FormulaError("a date pattern must be constant")
    return pattern.constant


# --- lists, packs, JSON, bytes ------------------------------------------------


def pack_items(items: Column) -> Column:
    """Texts to one: ``$`` and ``,`` in them are written $1 and $0."""
    escape = lambda s: F.replace(F.replace(F.coalesce(s, F.lit("")), F.lit("$"), F.lit("$1")), F.lit(","), F.lit("$0"))
    return F.array_join(F.transform(items, escape), ",")


def unpack_items(packed: Column) -> Column:
    restore = lambda s: F.replace(F.replace(s, F.lit("$0"), F.lit(",")), F.lit("$1"), F.lit("$"))
    return F.when(packed == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(packed, ","), restore))


def texts_of(x: Val, strict: bool) -> Column:
    """A list's items as an array of texts."""
    if x.parts is not None:
        return F.array(*(v.text(p, strict) for p in x.parts)) if x.parts else F.array().cast("array<string>")
    out = x.column()
    return out if x.item == TEXT else F.transform(out, lambda i: v.text(Val(i, None, x.item), strict))


@function("list", 0, ANY)
def _list(ctx, *args):
    kind = v.common_kind(list(args))
    if kind in (LIST, JSON):
        raise FormulaError("a list of lists has no type here")
    array = F.array(*(v.as_kind(x, kind, ctx.strict) for x in args)) if args else F.array().cast("array<string>")
    return Val(array, None, LIST, kind, tuple(args))


@function("items", 1)
def _items(ctx, x):
    return need(F.size(x.column()).cast("long"), LONG) if x.kind == LIST else v.invalid()


@function("nth", 2)
def _nth(ctx, x, index):
    if x.kind == JSON:
        k = v.integer(index)
        return need(F.try_variant_get(x.column(), F.concat(F.lit("$["), (k - 1).cast("string"), F.lit("]")), "variant"), JSON) if index.constant is None else need(F.try_variant_get(x.column(), f"$[{int(index.constant) - 1}]", "variant"), JSON)
    if x.kind != LIST:
        return v.invalid()
    if x.parts is not None:
        return _choose(ctx, index, *x.parts) if x.parts else v.invalid()
    k = v.integer(index).cast("int")
    inside = (k >= 1) & (k <= F.size(x.value))
    return Val(F.when(inside, F.try_element_at(x.value, F.when(inside, k))), F.coalesce(~inside, F.lit(True)), x.item)


@function("valueForKey", 2)
def _value_for_key(ctx, x, key):
    """In a list of keys and values in turn, the value behind the first such key; in JSON, the member."""
    if x.kind == JSON:
        if not isinstance(key.constant, str):
            raise FormulaError("a JSON key must be constant")
        path = "$['" + key.constant.replace("\\", "\\\\").replace("'", "\\'") + "']"
        return need(F.try_variant_get(x.column(), path, "variant"), JSON)
    if x.kind != LIST:
        return v.invalid()
    if x.parts is not None:
        pairs = [(F.coalesce(equality(k, key, True), F.lit(False)), value) for k, value in zip(x.parts[::2], x.parts[1::2])]
        return choice(pairs, ctx.strict) if pairs else v.invalid()
    texts = texts_of(x, ctx.strict)
    keys = F.filter(texts, lambda _, i: i % 2 == 0)
    k = F.array_position(keys, v.text(key, ctx.strict)).cast("int")
    inside = (k > 0) & (2 * k <= F.size(x.value))
    return Val(F.when(inside, F.try_element_at(x.value, F.when(inside, 2 * k))), F.coalesce(~inside, F.lit(True)), x.item)


@function("glue", 2)
def _glue(ctx, x, separator):
    if x.kind != LIST:
        return v.invalid()
    texts = texts_of(x, ctx.strict)
    return need(F.when(~F.exists(texts, lambda s: s.isNull()), join_by(texts, v.text(separator, ctx.strict))), TEXT)


def join_by(texts: Column, separator: Column) -> Column:
    """array_join with a separator that may be a column."""
    joined = F.aggregate(texts, F.lit(""), lambda total, s: F.concat(total, separator, s))
    return F.substring(joined, F.char_length(separator) + 1, F.char_length(joined))


@function("packList", 1)
def _pack_list(ctx, x):
    return need(pack_items(texts_of(x, ctx.strict)), TEXT) if x.kind == LIST else v.invalid()


@function("unpackList", 1)
def _unpack_list(ctx, x):
    return need(unpack_items(v.text(x, ctx.strict)), LIST, TEXT)


def joined_lists(lists: list[Val], ctx: Context) -> Val:
    if all(x.parts is not None for x in lists):
        return _list(ctx, *(p for x in lists for p in x.parts))
    items = {x.item for x in lists}
    if len(items) == 1:
        return need(F.concat(*(x.column() for x in lists)), LIST, items.pop())
    return need(F.concat(*(texts_of(x, ctx.strict) for x in lists)), LIST, TEXT)


@function("appendValueToList", 2, ANY)
def _append(ctx, x, *args):
    return joined_lists([x, _list(ctx, *args)], ctx) if x.kind == LIST else v.invalid()


@function("appendList", 2, ANY)
def _append_lists(ctx, *args):
    return joined_lists(list(args), ctx) if all(x.kind == LIST for x in args) else v.invalid()


@function("jsonArrayToPack", 1)
def _from_json(ctx, x):
    return need(F.try_parse_json(v.text(x)), JSON)


@function("jsonEncode", 1)
def _to_json(ctx, x):
    if x.kind == JSON:
        return need(F.to_json(x.column()), TEXT)
    return need(F.to_json(x.column()), TEXT) if x.kind == LIST else v.invalid()


def binary_of(x: Val) -> Column:
    return x.column() if x.kind == BYTES else F.lit(None).cast("binary")


@function("base64Encode", 1)
def _base64_encode(ctx, x):
    return need(F.base64(binary_of(x)), TEXT)


@function("base64Decode", 1)
def _base64_decode(ctx, x):
    return need(F.try_to_binary(v.text(x), F.lit("base64")), BYTES)


@function("hexEncode", 1)
def _hex_encode(ctx, x):
    return need(F.lower(F.hex(binary_of(x))), TEXT)


@function("hexDecode", 1)
def _hex_decode(ctx, x):
    return need(F.unhex(v.text(x)), BYTES)


@function("numberOfBytes", 1)
def _number_of_bytes(ctx, x):
    return need(F.octet_length(binary_of(x)).cast("long"), LONG)


# The charsets that have names in the language, and Spark's for them.
CHARSETS = {"UTF-8": "UTF-8", "UTF-16": "UTF-16", "UTF-16LE": "UTF-16LE", "UTF-16BE": "UTF-16BE", "UTF-32": "UTF-32", "ASCII": "US-ASCII", "LATIN1": "ISO-8859-1", "ISO-8859-1": "ISO-8859-1", "LATIN2": "ISO-8859-2", "MAC-ROMAN": "x-MacRoman", "CP1250": "windows-1250", "CP1251": "windows-1251", "CP1252": "windows-1252", "CP1253": "windows-1253", "CP1254": "windows-1254"}


def charset(x: Val) -> str:
    if not isinstance(x.constant, str) or x.constant.upper() not in CHARSETS:
        raise FormulaError(f"no charset {x.constant!r}; there are {', '.join(CHARSETS)}")
    return CHARSETS[x.constant.upper()]


@function("encodeString", 2)
def _encode(ctx, x, name):
    return need(F.encode(v.text(x, ctx.strict), charset(name)), BYTES)


@function("decodeString", 2)
def _decode(ctx, x, name):
    return need(F.decode(binary_of(x), charset(name)), TEXT)


# --- reducers over arguments --------------------------------------------------


def numbers(args: tuple[Val, ...]) -> list[Column]:
    return [v.number(x) for x in args]


@function("sum", 0, ANY)
def _sum(ctx, *args):
    return need(reduce(lambda p, q: p + q, numbers(args), F.lit(0.0)), DOUBLE)


@function("average", 0, ANY)
def _average(ctx, *args):
    return need(F.try_divide(reduce(lambda p, q: p + q, numbers(args), F.lit(0.0)), F.lit(float(len(args)))), DOUBLE)


def extreme(f: Callable, args: tuple[Val, ...]) -> Val:
    if not args:
        return v.invalid()
    own = [x.column() for x in args] if {x.kind for x in args} <= {LONG} else numbers(args)
    kind = LONG if {x.kind for x in args} <= {LONG} else DOUBLE
    return need(f(*own) if len(own) > 1 else own[0], kind)


@function("min", 0, ANY)
def _min(ctx, *args):
    return extreme(F.least, args)


@function("max", 0, ANY)
def _max(ctx, *args):
    return extreme(F.greatest, args)


@function("count", 0, ANY)
def _count(ctx, *args):
    return Val(reduce(lambda p, q: p + q, (x.isNotNull().cast("long") for x in numbers(args)), F.lit(0).cast("long")), None, LONG)


@function("countAll", 0, ANY)
def _count_all(ctx, *args):
    return v.constant(len(args))


@function("countDistinct", 0, ANY)
def _count_distinct(ctx, *args):
    texts = F.array(*(v.text(x, ctx.strict) for x in args)) if args else F.array().cast("array<string>")
    return Val(F.size(F.array_distinct(F.array_compact(texts))).cast("long"), None, LONG)


@function("concat", 0, ANY)
def _concat(ctx, *args):
    return Val(F.concat(F.lit(""), *(F.coalesce(v.text(x, ctx.strict), F.lit("")) for x in args)), v.either(*(x.invalid for x in args)), TEXT)


@function("pack", 0, ANY)
def _pack(ctx, *args):
    return Val(pack_items(F.array(*(v.text(x, ctx.strict) for x in args)) if args else F.array().cast("array<string>")), None, TEXT)


def ordered(args: tuple[Val, ...]) -> Column:
    return F.array_sort(F.array_compact(F.array(*numbers(args)) if args else F.array().cast("array<double>")))


def middle(args: tuple[Val, ...], high: bool) -> Column:
    a = ordered(args)
    n = F.size(a)
    k = (F.floor(n / 2) + 1 if high else F.floor((n + 1) / 2)).cast("int")
    return F.try_element_at(a, F.when(n > 0, k))


@function("medianLow", 0, ANY)
def _median_low(ctx, *args):
    return need(middle(args, False), DOUBLE)


@function("medianHigh", 0, ANY)
def _median_high(ctx, *args):
    return need(middle(args, True), DOUBLE)


@function("median", 0, ANY)
def _median(ctx, *args):
    return need((middle(args, False) + middle(args, True)) / 2, DOUBLE)


@function("medianPack", 0, ANY)
def _median_pack(ctx, *args):
    low, high = (v.text(Val(middle(args, h), None, DOUBLE), ctx.strict) for h in (False, True))
    return need(F.when(F.size(ordered(args)) % 2 == 0, pack_items(F.array(low, high))).otherwise(pack_items(F.array(low))), TEXT)


def variance(args: tuple[Val, ...], sample: bool) -> Column:
    """Of the numbers; any text or error among the arguments makes it invalid, empties are left out."""
    a = F.array_compact(F.array(*numbers(args)) if args else F.array().cast("array<double>"))
    n = F.size(a)
    mean = F.try_divide(F.aggregate(a, F.lit(0.0), lambda t, x: t + x), n.cast("double"))
    squares = F.aggregate(a, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean))
    wrong = reduce(lambda p, q: p | q, (v.number(x).isNull() & (x.flag | x.value.isNotNull()) for x in args), F.lit(False))
    return F.when(~wrong, F.try_divide(squares, (n - 1 if sample else n).cast("double")))


for _name, _sample, _root in (("variancePopulation", False, False), ("varianceSample", True, False), ("stdevPopulation", False, True), ("stdevSample", True, True)):
    ARITY[_name] = (0, None)
    FUNCTIONS[_name] = lambda ctx, *args, s=_sample, r=_root: need(F.sqrt(variance(args, s)) if r else variance(args, s), DOUBLE)
