"""Shared by the artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.operators.rules import matches
from siftlake.sources.records import LINEAGE


def lineage(df: DataFrame) -> list[str]:
    """Lineage columns the input carries; they are part of every key."""
    return [c for c in LINEAGE if c in df.columns]


def timestamp(value) -> Column | None:
    """A bound given as text, a timestamp or a column; empty means no bound."""
    if value is None or (isinstance(value, str) and value == ""):
        return None
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def is_binary(kind: Column) -> Column:
    return matches(kind, "BINARY")


def user_filter(username: Column, sid: Column, user_regex: str, sid_regex: str) -> Column:
    return matches(F.coalesce(username, F.lit("")), user_regex) & matches(F.coalesce(sid, F.lit("")), sid_regex)
