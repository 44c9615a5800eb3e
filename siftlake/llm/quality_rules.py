"""Quality rules as a short-circuit cascade.

Every rule looks at one document and says whether it rejects it. What a rule costs and how much
it rejects is measured on a sample, and the cascade asks the rules with the most rejections per
second first; a rejected document is not shown to later rules. The order changes the time a run
takes, never a verdict.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import byte_texts

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = _UPPER + bytes(range(ord("a"), ord("z") + 1)) + bytes(range(0x80, 0x100))
_CONTINUATION = bytes(range(0x80, 0xC0))


def _count(text: bytes, kept: bytes) -> int:
    return len(text) - len(text.translate(None, kept))


class Document:
    """One text and what rules have found out about it; each figure is made when first asked for."""

    def __init__(self, text: bytes):
        self.text = text
        self.words = text.split()

    def __getattr__(self, name: str):
        value = getattr(self, f"_{name}")()
        setattr(self, name, value)
        return value

    def _word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined) - _count(joined, _CONTINUATION)

    def _n_symbols(self) -> int:
        return len(self.text.translate(None, _NOT_SYMBOLS))

    def _lines(self) -> list[bytes]:
        return [line for line in self.text.split(b"\n") if line.strip(b" \t\r\x0b\x0c")]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _dup_line_bytes(self) -> int:
        return sum(map(len, self.lines)) - sum(map(len, set(self.lines)))

    def _n_repeat_words(self) -> int:
        """Words that stand in a three-word window found twice or more."""
        words = self.words
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen, twice = set(), set()
        for window in windows:
            (twice if window in seen else seen).add(window)
        covered, upto = 0, 0  # words before `upto` are counted
        for at, window in enumerate(windows):
            if window in twice:
                covered += at + 3 - max(at, upto)
                upto = at + 3
        return covered

    def _upper(self) -> int:
        return _count(self.text, _UPPER)

    def _letters(self) -> int:
        return _count(self.text, _LETTERS) - _count(self.text, _CONTINUATION)

    def _marks(self) -> int:
        return self.text.count(b"!") + self.text.count(b"?")

    def _bars(self) -> int:
        return self.words.count(b"|")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


#: Shares are compared as whole numbers, so that a verdict never depends on rounding.
RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > 5 * len(d.words)),
    Rule("bars", lambda d: 10 * d.bars > 2 * len(d.words)),
    Rule("marks", lambda d: 10 * d.marks > 5 * len(d.words)),
    Rule("capitals", lambda d: 10 * d.upper > 6 * d.letters),
    Rule("letters", lambda d: 10 * d.letters < 3 * d.word_chars),
    Rule("word_length", lambda d: not 2 * len(d.words) <= d.word_chars <= 25 * len(d.words)),
    Rule("line_copies", lambda d: 10 * d.dup_line_bytes > 3 * sum(map(len, d.lines))),
)


def base_failed(d: Document) -> bool:
    return len(d.words) < 50 or 100 * d.n_repeat_words > 50 * len(d.words)


def _profile(rules: tuple[Rule, ...]):
    schema = pa.schema([("rule", pa.string()), ("seconds", pa.float64()), ("rejected", pa.int64()), ("seen", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rule in rules:
                docs = [Document(t) for t in byte_texts(batch.column("text"))]
                start = time.perf_counter()
                rejected = sum(map(rule.rejects, docs))
                yield pa.RecordBatch.from_pydict({"rule": [rule.name], "seconds": [time.perf_counter() - start],
                                                  "rejected": [rejected], "seen": [len(docs)]}, schema)

    return run


def cascade_order(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7) -> list[str]:
    """Rule names by rejections per second on about `sample_rows` documents, most first.

    A document is in the sample by chance, wherever it is stored. Rules are timed in the tasks,
    and one row a rule comes back. Without rows, rules keep their given order.
    """
    rows = documents.count()
    if not rows:
        return [rule.name for rule in rules]
    text = documents.select(F.col("text").cast("string").alias("text"))
    measured = text.sample(min(1.0, sample_rows / rows), seed).mapInArrow(
        _profile(rules), "rule string, seconds double, rejected long, seen long")
    found = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9)
             for r in measured.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()}
    return sorted((rule.name for rule in rules), key=lambda name: -found.get(name, 0.0))


def _judge(rules: list[Rule], detail: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
              ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
              ("rejected_by", pa.string())]
    schema = pa.schema(fields)

    def verdict(d: Document) -> str | None:
        if base_failed(d):
            return "base"
        return next((rule.name for rule in rules if rule.rejects(d)), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in byte_texts(batch.column("text")):
                d = Document(text)
                by = verdict(d)
                rows.append((len(d.words), d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, by == "base", by is None, by))
            columns = list(zip(*rows)) or [()] * (len(fields) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, kind) for c, (_, kind) in zip(columns, fields[1:]))], schema=schema)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([verdict(Document(t)) is None for t in byte_texts(batch.column("text"))], pa.bool_()))

    return run if detail else keep


def _ordered(documents: DataFrame, rules: tuple[Rule, ...], order: list[str] | None) -> list[Rule]:
    by_name = {rule.name: rule for rule in rules}
    return [by_name[name] for name in order or cascade_order(documents, rules)]


def quality_rules(documents: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None) -> DataFrame:
    """Base figures and verdict of every document: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    `rejected_by` is the rule that ended the cascade, which depends on the measured order unless
    `order` fixes it; every other column does not. A null, empty or blank text has no words and
    fails the base rule. Repeated rows are judged alike; an empty table gives no rows. Work is per
    row, so there is no shuffle, and a very long text is one row of one task.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_judge(_ordered(documents, rules, order), True),
                           "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                           "n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


def accepted_documents(documents: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None) -> DataFrame:
    """The documents that every rule lets pass, with all their columns; figures that no rule asks
    for are never made. Null, empty and blank texts fail the base rule and go; nulls in other
    columns stay as they are. Repeated rows go or stay together; an empty table stays empty."""
    return documents.mapInArrow(_judge(_ordered(documents, rules, order), False), documents.schema)
