"""Path, name and URL expressions. Built-in functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_PATTERN = r"^[A-Za-z0-9._-]+$"

# One run of Unicode white space; valid for Java and RE2.
_SPACE_RUN = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]+$", "$1")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def component(path: Column, index: int, sep: str = "/") -> Column:
    """Path component by zero-based index, negative from the end; null if absent."""
    return F.get(F.split(path, re.escape(sep)), F.lit(index)) if index >= 0 else F.try_element_at(
        F.split(path, re.escape(sep)), F.lit(index)
    )


def sanitize_name(name: Column) -> Column:
    """Turn any text into a column or table name: a whitespace run becomes one
    underscore, every other character outside [A-Za-z0-9_] one underscore each."""
    return F.regexp_replace(F.regexp_replace(name, _SPACE_RUN, "_"), r"[^A-Za-z0-9_]", "_")


def sanitize_name_py(name: str) -> str:
    """The same rule for names known on the driver (schemas)."""
    return re.sub(r"[^A-Za-z0-9_]", "_", re.sub(r"\s+", "_", name))


def table_name(path: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), sanitize_name(stem(path)))


def artifact_call_name(call: Column) -> Column:
    """`Name(arg=1)` -> `Name`."""
    return F.trim(F.substring_index(call, "(", 1))


def rid(sid: Column) -> Column:
    """Last dash-separated part of a security identifier."""
    return F.substring_index(sid, "-", -1)


def url_decode(path: Column) -> Column:
    """Percent-decode a member path; a plus sign stays a plus sign. Text that is
    not valid percent-encoding is returned unchanged."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_last_segment(url: Column) -> Column:
    return basename(F.trim(F.regexp_replace(url_path(url), r"^/+|/+$", "")))


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def glob_regex(pattern: str) -> str:
    """Whole-string, case-sensitive shell glob as a regular expression. `*` also
    crosses `/`. The result is valid for Java and RE2."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            start = i + 1 if pattern[i : i + 1] in ("!", "^") else i
            end = pattern.find("]", start + 1)
            if end < 0:
                out.append(r"\[")
                continue
            negated = pattern[i] == "!"
            body = pattern[i + 1 if negated else i : end]
            body = body.replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&&", "&\\&")
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end + 1
        else:
            out.append(re.escape(ch) if not ch.isalnum() and ch != "_" else ch)
    return r"(?s)\A(?:" + "".join(out) + r")\z"


def glob_match(value: Column, pattern: str) -> Column:
    return value.rlike(glob_regex(pattern))
