"""Functions of the formula language as functions of SQL: inlined expressions, no Python."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .compiler import compile_formula
from .formula import FormulaError
from .language import ENGLISH

T, N, D, B = "STRING", "DOUBLE", "TIMESTAMP", "BINARY"
#: The types of a function's arguments in SQL.  Texts that hold numbers count as numbers in formulas; SQL names one type.
ARGUMENTS: dict[str, tuple[str, ...]] = {
    "upper": (T,), "lower": (T,), "capitalize": (T,), "trim": (T,), "length": (T,), "urlencode": (T,), "left": (T, N), "right": (T, N), "mid": (T, N, N), "substitute": (T, T, T),
    "regexSubstitute": (T, T, T), "levenshtein": (T, T), "concat": (T, T), "split": (T, T), "parseNumber": (T, T, T), "unpackList": (T,),
    "negate": (N,), "abs": (N,), "sign": (N,), "exp": (N,), "ln": (N,), "sqrt": (N,), "floor": (N,), "ceiling": (N,), "cos": (N,), "sin": (N,), "tan": (N,), "cosh": (N,), "sinh": (N,), "tanh": (N,),
    "acos": (N,), "asin": (N,), "atan": (N,), "log": (N, N), "power": (N, N), "round": (N,), "powerUp": (N, N), "powerDown": (N, N), "normalInverse": (N, N, N), "random": (), "randomBetween": (N, N),
    "toUnix": (D,), "fromUnix": (N,), "fromISO8601": (T,), "toUTCISO8601": (D,), "toExcelDate": (D,), "fromExcelDate": (N,), "date": (N, N, N), "day": (D,), "month": (D,), "year": (D,), "hour": (D,), "minute": (D,),
    "second": (D,), "duration": (D, D), "after": (D, N), "toUnicodeDateString": (D, T), "fromUnicodeDateString": (T, T), "now": (), "uuid": (),
    "hexEncode": (B,), "hexDecode": (T,), "base64Encode": (B,), "base64Decode": (T,), "numberOfBytes": (B,), "encodeString": (T, T), "decodeString": (B, T), "sum": (N, N), "average": (N, N), "min": (N, N), "max": (N, N),
}


#: Why functions were left out, by name.
LEFT_OUT: dict[str, str] = {}


def register_functions(spark: SparkSession, prefix: str = "f_") -> list[str]:
    """Makes temporary SQL functions ``f_upper``, ``f_read_number`` and so on; returns their names.

    Each is the expression that the formula compiles to, so Catalyst sees through it.  An
    argument that must be a constant in formulas (a pattern, an encoding) may be a column
    here only where Spark's own function takes one; such functions are left out.
    """
    made = []
    for key, kinds in ARGUMENTS.items():
        name = ENGLISH[key]
        empty = spark.range(1).select(*(F.lit(None).cast(t).alias(f"a{k}") for k, t in enumerate(kinds)))
        own = prefix + name.lower().replace(".", "_")
        try:
            value = compile_formula(f"{name}({';'.join(f'[a{k}]' for k in range(len(kinds)))})", empty).column().alias("value")
            plan = empty.select(value)
            body = plan._jdf.queryExecution().analyzed().expressions().head().child().sql()
            given = ", ".join(f"a{k} {t}" for k, t in enumerate(kinds))
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {own}({given}) RETURNS {plan.schema[0].dataType.simpleString()} RETURN {body}")
        except (FormulaError, PySparkException) as e:  # a constant is wanted, or Spark writes an expression as SQL that it does not read
            LEFT_OUT[own] = str(e).split("\n")[0]
            continue
        made.append(own)
    return made
