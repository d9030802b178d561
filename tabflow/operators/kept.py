"""Tables that are kept in memory or on disk on the way to a result."""

from __future__ import annotations

from pyspark.sql import DataFrame

_KEPT: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """``df``, persisted until ``release``; it spills to disk and is computed again if lost."""
    _KEPT.append(df.persist())
    return _KEPT[-1]


def release() -> None:
    """Lets go of all kept tables: call it when the results that read them are there."""
    while _KEPT:
        _KEPT.pop().unpersist()
