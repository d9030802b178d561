"""Names for columns."""

from __future__ import annotations

from collections.abc import Iterable


def default_name(index: int) -> str:
    """A, B, ... Z, then BA, BB and so on: the index in base 26 with A for 0."""
    out = ""
    while True:
        index, digit = divmod(index, 26)
        out = chr(65 + digit) + out
        if not index:
            return out


def new_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or with the first of _A, _B, ... that makes it new (case does not count)."""
    known = {t.lower() for t in taken}
    if name.lower() not in known:
        return name
    k = 0
    while f"{name}_{default_name(k)}".lower() in known:
        k += 1
    return f"{name}_{default_name(k)}"
