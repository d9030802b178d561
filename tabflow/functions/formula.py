"""The formula language: text to tree and back.

Precedence, from low: comparisons (left to right, any number), ``&``, ``+ -``,
``* / ~``, ``^``, then ``[index]`` and ``->key`` behind a value.
"""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass

from .language import ERROR, LANGUAGES, POSTFIXES, Language


class FormulaError(ValueError):
    """The text is no formula."""


@dataclass(frozen=True)
class Literal:
    """A constant: number, text, boolean, bytes, None (empty) or ERROR (invalid)."""

    value: object


@dataclass(frozen=True)
class Timestamp:
    """Seconds since 2001-01-01T00:00:00Z."""

    seconds: float


@dataclass(frozen=True)
class Current:
    """The cell's own value before a calculation."""


@dataclass(frozen=True)
class Column_:
    """A column of the row, or of the joined row if ``foreign``."""

    name: str
    foreign: bool = False


@dataclass(frozen=True)
class Call:
    function: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Binary:
    """``op`` is one of the tokens in BINARY."""

    op: str
    left: Node
    right: Node


Node = Literal | Timestamp | Current | Column_ | Call | Binary

#: Tokens by precedence, low first (fixed values).
LEVELS = [["~~=", "~=", "±±=", "±=", ">=", "<=", "<>", ">", "<", "="], ["&"], ["+", "-"], ["*", "/", "~"], ["^"]]
BINARY = [op for level in LEVELS for op in level]
NUMBER_START = re.compile(r"[0-9]")
NAME = re.compile(r"[A-Za-z_À-ɏ][A-Za-z0-9_À-ɏ]*(?:\.[A-Za-z0-9_À-ɏ]+)*")


class Parser:
    """Recursive descent over one formula."""

    def __init__(self, text: str, language: Language):
        self.text, self.language, self.at = text, language, 0
        grouping, decimal = re.escape(language.grouping), re.escape(language.decimal)
        self.number = re.compile(rf"([0-9](?:[0-9{grouping}]*))({decimal}[0-9]+)?")

    def fail(self, what: str):
        raise FormulaError(f"{what} at {self.at} in {self.text!r}")

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def eat(self, token: str) -> bool:
        self.space()
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.eat(token):
            self.fail(f"{token!r} is missing")

    def formula(self) -> Node:
        self.eat("=")
        out = self.level(0)
        self.space()
        if self.at < len(self.text):
            self.fail("more text than a formula")
        return out

    def operator(self, k: int) -> str | None:
        self.space()
        # The longest token here decides: "~=" is no modulus and "->" no subtraction.
        if self.text.startswith("->", self.at):
            return None
        found = max((op for op in BINARY if self.text.startswith(op, self.at)), key=len, default=None)
        return found if found in LEVELS[k] else None

    def level(self, k: int) -> Node:
        if k == len(LEVELS):
            return self.indexed()
        out = self.level(k + 1)
        while op := self.operator(k):
            self.at += len(op)
            out = Binary(op, out, self.level(k + 1))
        return out

    def indexed(self) -> Node:
        out = self.value()
        while True:
            if self.eat("["):
                out = Call("nth", (out, self.level(0)))
                self.need("]")
            elif self.eat("->"):
                out = Call("valueForKey", (out, self.value()))
            else:
                return out

    def arguments(self, close: str) -> tuple[Node, ...]:
        if self.eat(close):
            return ()
        out = [self.level(0)]
        while self.eat(";"):
            out.append(self.level(0))
        self.need(close)
        return tuple(out)

    def quoted(self, sign: str, double: bool) -> str:
        out = ""
        while True:
            end = self.text.find(sign, self.at)
            if end < 0:
                self.fail(f"{sign} is missing")
            out += self.text[self.at : end]
            self.at = end + 1
            if not double or not self.text.startswith(sign, self.at):
                return out
            out += sign
            self.at += 1

    def digits(self) -> Node:
        found = self.number.match(self.text, self.at)
        if not found:
            self.fail("a number is missing")
        self.at = found.end()
        whole, part = found[1].replace(self.language.grouping, ""), found[2]
        number = float(f"{whole}.{part[1:]}") if part else int(whole)
        for postfix in sorted(POSTFIXES, key=len, reverse=True):
            if self.text.startswith(postfix, self.at) and not NAME.match(self.text, self.at + len(postfix)):
                self.at += len(postfix)
                product = number * POSTFIXES[postfix]
                return Literal(int(product) if isinstance(number, int) and POSTFIXES[postfix] > 1 and product == int(product) and abs(product) < 1 << 53 else product)
        return Literal(number)

    def value(self) -> Node:
        self.space()
        here = self.text[self.at : self.at + 1]
        if NUMBER_START.match(here):
            return self.digits()
        if here == "-":
            self.at += 1
            inner = self.value()
            if isinstance(inner, Literal) and isinstance(inner.value, (int, float)) and not isinstance(inner.value, bool):
                return Literal(-inner.value)
            return Call("negate", (inner,))
        if here == "@":
            self.at += 1
            if NUMBER_START.match(self.text[self.at : self.at + 1]):
                found = self.number.match(self.text, self.at)
                self.at = found.end()
                return Timestamp(float(found[1].replace(self.language.grouping, "") + (f".{found[2][1:]}" if found[2] else "")))
            return Current()
        if here == '"':
            self.at += 1
            return Literal(self.quoted('"', True))
        if here == "`":
            self.at += 1
            try:
                return Literal(base64.b64decode(self.quoted("`", False), validate=True))
            except ValueError:
                self.fail("these bytes are no base64")
        if here == "{":
            self.at += 1
            return Call("list", self.arguments("}"))
        if here == "(":
            self.at += 1
            out = self.level(0)
            self.need(")")
            return out
        foreign = here == "#"
        if foreign:
            self.at += 1
        if self.text.startswith("[", self.at):
            self.at += 1
            name = self.quoted("]", False)
            return Column_(name.removeprefix("@"), foreign)
        found = NAME.match(self.text, self.at)
        if not found:
            self.fail("a value is missing")
        self.at = found.end()
        name = found[0]
        if foreign:
            return Column_(name, True)
        if name.upper() in self.language.functions and self.eat("("):
            return self.checked(self.language.functions[name.upper()], self.arguments(")"))
        if name.upper() in self.language.constants:
            return Literal(self.language.constants[name.upper()])
        return Column_(name)

    def checked(self, function: str, args: tuple[Node, ...]) -> Node:
        from .compiler import ARITY

        low, high = ARITY[function]
        if not low <= len(args) <= (high if high is not None else len(args)):
            self.fail(f"{self.language.name_of(function)} takes another number of arguments")
        return Call(function, args)


def parse(text: str, language: str | Language = "en") -> Node:
    """The tree of a formula; FormulaError if it is none."""
    return Parser(text, LANGUAGES[language] if isinstance(language, str) else language).formula()


def to_formula(node: Node, language: str | Language = "en", tight: int = 0) -> str:
    """The text of a tree; parsing it gives the tree again."""
    own = LANGUAGES[language] if isinstance(language, str) else language
    match node:
        case Literal(value):
            for name, constant in own.constants.items():
                if value is constant or (isinstance(constant, float) and value == constant and isinstance(value, float)):
                    return name
            if isinstance(value, str):
                return '"' + value.replace('"', '""') + '"'
            if isinstance(value, bytes):
                return "`" + base64.b64encode(value).decode() + "`"
            text = repr(value) if isinstance(value, int) else format(value, "f") if value == float(format(value, "f")) else format(value, ".340f").rstrip("0")
            return text.replace(".", own.decimal)
        case Timestamp(seconds):
            return "@" + (repr(int(seconds)) if seconds == int(seconds) else repr(seconds).replace(".", own.decimal))
        case Current():
            return "@"
        case Column_(name, foreign):
            return ("#" if foreign else "") + f"[{name}]"
        case Call("list", args):
            return "{" + ";".join(to_formula(a, own) for a in args) + "}"
        case Call("nth", (a, b)):
            return f"{to_formula(a, own, len(LEVELS))}[{to_formula(b, own)}]"
        case Call("valueForKey", (a, b)):
            return f"{to_formula(a, own, len(LEVELS))}->{to_formula(b, own, len(LEVELS) + 1)}"
        case Call(function, args):
            return f"{own.name_of(function)}({';'.join(to_formula(a, own) for a in args)})"
        case Binary(op, left, right):
            level = next(k for k, ops in enumerate(LEVELS) if op in ops)
            text = f"{to_formula(left, own, level)}{op}{to_formula(right, own, level + 1)}"
            return f"({text})" if level < tight else text
    raise TypeError(node)


def to_json(node: Node) -> object:
    """A tree as plain JSON values."""
    match node:
        case Literal(value):
            if isinstance(value, bytes):
                return {"bytes": base64.b64encode(value).decode()}
            return {"error": True} if value is ERROR else {"value": value}
        case Timestamp(seconds):
            return {"timestamp": seconds}
        case Current():
            return {"current": True}
        case Column_(name, foreign):
            return {"foreign" if foreign else "column": name}
        case Call(function, args):
            return {"call": function, "args": [to_json(a) for a in args]}
        case Binary(op, left, right):
            return {"op": op, "left": to_json(left), "right": to_json(right)}
    raise TypeError(node)


def from_json(data: object) -> Node:
    """The tree that ``to_json`` wrote."""
    match data:
        case str():
            return from_json(json.loads(data))
        case {"value": value}:
            return Literal(value)
        case {"bytes": text}:
            return Literal(base64.b64decode(text))
        case {"error": _}:
            return Literal(ERROR)
        case {"timestamp": seconds}:
            return Timestamp(seconds)
        case {"current": _}:
            return Current()
        case {"column": name}:
            return Column_(name)
        case {"foreign": name}:
            return Column_(name, True)
        case {"call": function, "args": args}:
            return Call(function, tuple(from_json(a) for a in args))
        case {"op": op, "left": left, "right": right}:
            return Binary(op, from_json(left), from_json(right))
    raise FormulaError(f"no tree: {data!r}")


def columns_of(node: Node, foreign: bool = False) -> set[str]:
    """Names of the row's own columns in a tree, or of the joined row's."""
    match node:
        case Column_(name, f):
            return {name} if f == foreign else set()
        case Call(_, args):
            return set().union(*(columns_of(a, foreign) for a in args))
        case Binary(_, left, right):
            return columns_of(left, foreign) | columns_of(right, foreign)
    return set()
