"""Tokens of the sections of a document, from one encoding of the whole document.

The encoding gives each token its character span; sections have spans as well, and the two are
joined by interval. Both belong to one document, so the join is a merge along it inside a task
and nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Which section a token that crosses boundaries counts for: that of its first character, that of
#: its last, or that with most of its characters (the earliest of equals).
RULES = ("first", "last", "most")


class SpanEncoder:
    """Token spans of whole texts with a byte-level vocabulary given as ranks.

    Such tokens, put together, are the bytes of the text, so the lengths of the tokens give their
    spans. Offsets count characters: a token that starts within a character starts at it.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def byte_ends(self, text: str) -> np.ndarray:
        return np.cumsum(self.lengths[self.encoding.encode_ordinary(text)])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last character of each token."""
        ends = self.byte_ends(text)
        starts = np.concatenate([ends[:0], [0], ends[:-1]]) if len(ends) else ends
        if text.isascii():
            return starts, ends - 1
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        return character[starts], character[ends - 1]


_ENCODERS: dict[tuple[str, str], SpanEncoder] = {}


def line_sections(text: str) -> np.ndarray:
    """Starts of the sections of a text: its lines, each with the line feed that ends it."""
    breaks = [0]
    at = text.find("\n")
    while at >= 0:
        breaks.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(breaks if breaks[-1] < len(text) or len(breaks) == 1 else breaks[:-1], np.int64)


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, length: int, rule: str) -> np.ndarray:
    """Tokens of each section. Spans and sections are both in order, so one binary search a token
    is the interval join; only tokens that touch several sections are looked at further."""
    lo = np.searchsorted(starts, first, "right") - 1
    hi = np.searchsorted(starts, last, "right") - 1
    chosen = hi if rule == "last" else lo
    if rule == "most":
        ends = np.append(starts[1:], length)
        chosen = lo.copy()
        for t in np.flatnonzero(lo != hi):
            touched = np.arange(lo[t], hi[t] + 1)
            shared = np.minimum(ends[touched], last[t] + 1) - np.maximum(starts[touched], first[t])
            chosen[t] = touched[shared.argmax()]
    return np.bincount(chosen, minlength=len(starts))


def _count(path: str, pattern: str, rule: str, block: int = 50_000):
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64())])

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        ids = [i for i, starts, _, _ in parts for _ in range(len(starts))]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()),
            pa.array(np.concatenate([np.arange(len(s), dtype=np.int32) for _, s, _, _ in parts])),
            pa.array(np.concatenate([s for _, s, _, _ in parts])),
            pa.array(np.concatenate([n for _, _, n, _ in parts])),
            pa.array(np.concatenate([t for _, _, _, t in parts]).astype(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault((path, pattern), None) or SpanEncoder(path, pattern)
        _ENCODERS[path, pattern] = encoder
        for batch in batches:
            parts, held = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                starts = line_sections(text)
                first, last = encoder.spans(text)
                tokens = attribute(first, last, starts, len(text), rule)
                parts.append((doc_id, starts, np.diff(np.append(starts, len(text))), tokens))
                held += len(starts)
                if held >= block:
                    yield rows(parts)
                    parts, held = [], 0
            if parts:
                yield rows(parts)

    return run


def section_tokens(documents: DataFrame, ranks_path: str, pattern: str, rule: str = "most") -> DataFrame:
    """Tokens of every section (line) of every whole text: doc_id, section, start, n_chars, n_tokens.

    The sections of a text add up to its characters and its tokens, whatever the rule. A null or
    empty text is one empty section without tokens. Repeated rows and null ids are reported as
    they are; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count(ranks_path, pattern, rule), "doc_id long, section int, start long, n_chars long, n_tokens long")
