"""Ignore rules and simple gates."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import paths


NO_FILTER = ("", ".", ".*")


@dataclass(frozen=True)
class IgnoreRules:
    """Name globs are tested on the file name, path globs on the whole member path."""

    names: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str | None) -> "IgnoreRules":
        """A missing or unreadable configuration means no rules."""
        try:
            doc = json.loads(text or "")
            return cls(list(doc.get("ignorelist") or []), list(doc.get("ignorepattern") or []))
        except (ValueError, AttributeError):
            return cls()


def ignore_decision(member: Column, size: Column, rules: IgnoreRules) -> Column:
    """struct(ignored, reason, pattern); the first rule that applies wins. The rules come
    from one configuration file, so they are part of the expression."""

    def result(ignored: bool, reason: str | None = None, pattern: str | None = None) -> Column:
        return F.struct(
            F.lit(ignored).alias("ignored"),
            F.lit(reason).cast("string").alias("reason"),
            F.lit(pattern).cast("string").alias("pattern"),
        )

    name = paths.basename(member)
    out = (
        F.when(member.endswith("/"), result(True, "directory"))
        .when(~(member.endswith(".json") | member.endswith(".jsonl")), result(True, "not_json"))
        .when(size == 0, result(True, "empty"))
    )
    for glob in rules.names:
        out = out.when(paths.glob_match(name, glob), result(True, "name_rule", glob))
    for glob in rules.paths:
        out = out.when(paths.glob_match(member, glob), result(True, "path_rule", glob))
    return out.otherwise(result(False))


def with_ignore_decision(members: DataFrame, rules: IgnoreRules, member: str = "member",
                         size: str = "size") -> DataFrame:
    decision = ignore_decision(F.col(member), F.col(size), rules)
    return members.withColumn("_d", decision).select(
        *members.columns,
        paths.basename(F.col(member)).alias("basename"),
        F.col("_d.ignored").alias("ignored_upload"),
        F.col("_d.reason").alias("ignored_reason"),
        F.col("_d.pattern").alias("ignored_pattern"),
    )


def matches(value: Column, pattern: str) -> Column:
    """Case-insensitive regular expression search. The default filter `.` means no filter, so
    it also keeps rows without a value."""
    if pattern in NO_FILTER:
        return F.lit(True)
    return value.rlike("(?i)" + pattern)


def any_matches(values: Column, pattern: str) -> Column:
    """The same over a list: some element matches; without a filter an empty list is kept."""
    if pattern in NO_FILTER:
        return F.lit(True)
    return F.exists(values, lambda value: matches(value, pattern))


def contains_text(query: str, *columns: Column) -> Column:
    """Case-insensitive substring search in any of the columns; an empty query keeps all."""
    if not query:
        return F.lit(True)
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.lower(F.coalesce(column, F.lit(""))).contains(query.lower())
    return hit


def has_status(status: Column, wanted: str) -> Column:
    if not wanted:
        return F.lit(True)
    return F.lower(F.coalesce(status, F.lit(""))) == wanted.lower()


def safe_id(value: Column) -> Column:
    return F.coalesce(value.rlike(paths.ID_PATTERN), F.lit(False))
