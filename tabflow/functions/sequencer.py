"""Sequences: all texts that a small pattern describes, numbered.

A pattern is made of characters, ``[sets]``, ``(groups)``, ``a|b``, ``x?`` and ``x{n}``;
a backslash takes the next character as it is (``\\t`` ``\\n`` ``\\r``: as usual).  A range
a-Z or A-z means all letters; a range that runs backwards is empty.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPES = {"t": "\t", "n": "\n", "r": "\r"}
SPECIAL = set("[](){}|?\\'\"")


@dataclass(frozen=True)
class Sequence:
    """A node: characters to pick from, members in a row, or alternatives."""

    kind: str  # "pick", "row", "either"
    picks: str = ""
    members: tuple[Sequence, ...] = ()

    @staticmethod
    def parse(pattern: str) -> Sequence:
        out, at = _either(pattern, 0)
        if at < len(pattern):
            raise ValueError(f"no sequence: {pattern!r}, from place {at}")
        return out

    @property
    def size(self) -> int:
        sizes = [m.size for m in self.members]
        return len(self.picks) if self.kind == "pick" else math.prod(sizes) if self.kind == "row" else sum(sizes)

    @property
    def cardinality(self) -> int | None:
        """How many texts there are; None if too many for a long."""
        return self.size if self.size < 1 << 63 else None

    def at(self, index: Column) -> Column:
        """The text with a number from 0, as a column: digits of a mixed radix pick the characters."""
        if self.kind == "pick":
            return F.lit("") if not self.picks else F.substring(F.lit(self.picks), index.cast("int") + 1, F.lit(1))
        if self.kind == "row":
            out, below = [], self.size
            for m in self.members:
                below //= max(1, m.size)
                out.append(m.at(F.pmod(F.floor(index / F.lit(below).cast("decimal(20,0)")) if below > 1 << 52 else _whole(index, below), F.lit(max(1, m.size)))))
            return F.concat(F.lit(""), *out)
        out, start = None, 0
        for m in self.members:
            own = m.at(index - start)
            out = F.when(index < start + m.size, own) if out is None else out.when(index < start + m.size, own)
            start += m.size
        return out

    def random(self) -> Column:
        """A random member; each pick is drawn alone, alternatives in proportion to their sizes."""
        if self.kind == "pick":
            return F.substring(F.lit(self.picks), F.floor(F.rand() * len(self.picks)).cast("int") + 1, F.lit(1)) if self.picks else F.lit(None).cast("string")
        if self.kind == "row":
            return F.concat(F.lit(""), *(m.random() for m in self.members))
        out, left = None, self.size
        for m in self.members:
            share = F.rand() < m.size / left if left else F.lit(False)
            out = F.when(share, m.random()) if out is None else out.when(share, m.random())
            left -= m.size
        return out


EMPTY = Sequence("row")


def _whole(index: Column, divisor: int) -> Column:
    return index if divisor == 1 else F.floor((index - F.pmod(index, F.lit(divisor))) / divisor).cast("long")


def _either(p: str, at: int) -> tuple[Sequence, int]:
    parts = []
    while True:
        part, at = _row(p, at)
        parts.append(part)
        if p[at : at + 1] != "|":
            return (parts[0] if len(parts) == 1 else Sequence("either", members=tuple(parts))), at
        at += 1


def _row(p: str, at: int) -> tuple[Sequence, int]:
    out = []
    while at < len(p) and p[at] not in "|)":
        c = p[at]
        if c == "[":
            item, at = _set(p, at + 1)
        elif c == "(":
            item, at = _either(p, at + 1)
            if p[at : at + 1] != ")":
                raise ValueError(f"no sequence: {p!r}, ) is missing")
            at += 1
        elif c == "\\" and at + 1 < len(p):
            item, at = Sequence("pick", ESCAPES.get(p[at + 1], p[at + 1])), at + 2
        elif c in SPECIAL:
            raise ValueError(f"no sequence: {p!r}, {c} at {at}")
        else:
            # Plain characters up to the next sign belong together: "foo?" has all of foo or none.
            end = at
            while end < len(p) and p[end] not in SPECIAL:
                end += 1
            item, at = Sequence("row", members=tuple(Sequence("pick", x) for x in p[at:end])), end
        if p[at : at + 1] == "?":
            item, at = Sequence("either", members=(EMPTY, item)), at + 1
        elif p[at : at + 1] == "{":
            end = p.find("}", at)
            if end < 0 or not p[at + 1 : end].isdigit():
                raise ValueError(f"no sequence: {p!r}, a count at {at}")
            item, at = Sequence("row", members=(item,) * int(p[at + 1 : end])), end + 1
        out.append(item)
    return (out[0] if len(out) == 1 else Sequence("row", members=tuple(out))), at


def _set(p: str, at: int) -> tuple[Sequence, int]:
    found: list[str] = []

    def one(at: int) -> tuple[str, int]:
        if p[at : at + 1] == "\\" and at + 1 < len(p):
            return ESCAPES.get(p[at + 1], p[at + 1]), at + 2
        if at >= len(p):
            raise ValueError(f"no sequence: {p!r}, ] is missing")
        return p[at], at + 1

    while p[at : at + 1] != "]":
        low, at = one(at)
        if p[at : at + 1] == "-" and p[at + 1 : at + 2] not in ("]", ""):
            high, at = one(at + 1)
            if (low, high) in (("a", "Z"), ("A", "z")):
                found += string.ascii_letters
            else:
                found += [chr(c) for c in range(ord(low), ord(high) + 1)]
        else:
            found.append(low)
    return Sequence("pick", "".join(dict.fromkeys(found))), at + 1


def sequence_table(spark: SparkSession, pattern: str, column: str = "Value") -> DataFrame:
    """One row for each text of a pattern, made from a range of numbers in all tasks."""
    root = Sequence.parse(pattern)
    if root.cardinality is None:
        raise ValueError(f"{pattern!r} describes too many texts to list")
    return spark.range(root.size).select(root.at(F.col("id")).alias(column))


def range_table(spark: SparkSession, low: int, high: int, column: str = "Value") -> DataFrame:
    """The whole numbers from ``low`` to ``high``, both included."""
    if high <= low:
        raise ValueError("the range's end must be greater than its start")
    return spark.range(low, high + 1).withColumnRenamed("id", column)


