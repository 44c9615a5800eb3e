"""URL verdicts: listed rules first, then a ratio of two character language models.

Both models are variable-order Markov models of host and path: a context is known if it has a
stated share of its class's characters, which bounds the model whatever the input, and the
probability of a character is interpolated from the shortest known context to the longest
(Witten-Bell). The difference of the log-likelihoods per character is held against a threshold
calibrated on pages that neither model has seen.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import ascii_lower

#: Host and path of a rule, and its verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Words in a host name that mark a page as an example of what to reject.
SUSPECT = ("spam", "pills", "casino", "gambling", "porn", "xxx", "viagra", "phish", "malware", "warez")
ORDER = 5
#: A string is in the model if it is this share of all strings of its length in either class, so
#: there are at most 2 * (ORDER + 1) / MIN_SHARE strings.
MIN_SHARE = 1 / 20_000
#: The threshold lets at most this share of unseen pages that were not rejected be blocked.
FALSE_BLOCKS = 0.005
START, END = "\x02", "\x03"
_BINS = 1000


def host_and_path(url: Column) -> list[Column]:
    whole = F.coalesce(url.cast("string"), F.lit(""))
    parts = "://([^/?#]*)([^?#]*)"
    return [ascii_lower(F.regexp_extract(whole, parts, 1)).alias("host"), F.regexp_extract(whole, parts, 2).alias("path")]


def listed_rule(rules: dict[str, str]) -> Column:
    """The longest rule that fits host and path; of equally long ones, the first listed."""
    tests = []
    for rule in sorted(rules, key=len, reverse=True):
        host, slash, path = rule.partition("/")
        fits = (F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))
        tests.append(F.when(fits & F.startswith("path", F.lit(slash + path)), rule))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def _known(pages: DataFrame, rules: dict[str, str], suspect: tuple[str, ...], folds: int) -> DataFrame:
    parts = pages.select(F.col("page_id"), *host_and_path(F.col("url"))).withColumn("rule", listed_rule(rules))
    listed = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.col("rule")] if rules else F.lit(None).cast("string")
    bad_host = F.col("host").rlike("|".join(suspect)) if suspect else F.lit(False)
    fold = F.pmod(F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    return parts.withColumn("listed", listed).withColumn(
        "rejected", F.coalesce(F.col("listed") == "block", F.lit(False)) | (F.col("listed").isNull() & bad_host)).withColumn(
        "unseen", fold == 0)


def _strings(order: int, flush: int = 200_000):
    schema = pa.schema([("string", pa.string()), ("rejected", pa.int64()), ("accepted", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for host, path, rejected in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "rejected"))):
                line = START + host + path + END
                count = counts[not rejected]
                for n in range(1, order + 2):
                    count.update([line[at:at + n] for at in range(len(line) - n + 1)])
                if len(counts[0]) + len(counts[1]) >= flush:
                    yield rows(counts)
                    counts = (Counter(), Counter())
        if counts[0] or counts[1]:
            yield rows(counts)

    def rows(counts) -> pa.RecordBatch:
        strings = list(counts[0] | counts[1])
        return pa.RecordBatch.from_arrays([pa.array(strings), *(pa.array([c[s] for s in strings], pa.int64()) for c in counts)], schema=schema)

    return run


class UrlModel:
    """Two Markov models over the same strings: counts are (rejected, accepted)."""

    def __init__(self, strings: dict[str, tuple[int, int]], order: int):
        self.strings, self.order = strings, order
        totals, kinds, kept = [0, 0], {}, {}
        for string, counts in strings.items():
            context = string[:-1]
            k, t = kinds.setdefault(context, [0, 0]), kept.setdefault(context, [0, 0])
            for c in (0, 1):
                k[c] += counts[c] > 0
                t[c] += counts[c]
                totals[c] += counts[c] if not context else 0
        #: For each context: what a lower order counts for, and the sum it is divided by.
        self.contexts = {}
        for context, k in kinds.items():
            seen = totals if not context else strings.get(context, (0, 0))
            self.contexts[context] = [(k[c] + max(0, seen[c] - kept[context][c]), max(seen[c], kept[context][c]) + k[c]) for c in (0, 1)]
        self.cache: dict[str, float] = {}

    def _difference(self, before: str, char: str) -> float:
        logs = []
        for c in (0, 1):
            p = 1 / 256
            for n in range(len(before) + 1):
                context = before[len(before) - n:]
                weights = self.contexts.get(context)
                if weights is None:
                    break
                lower, total = weights[c]
                if total:
                    p = (self.strings.get(context + char, (0, 0))[c] + lower * p) / total
            logs.append(math.log(p))
        return logs[0] - logs[1]

    def score(self, host: str, path: str) -> float:
        """Log-likelihood of the rejected model less that of the accepted one, per character."""
        if not host and not path:
            return 0.0
        line = START + host + path + END
        total = 0.0
        for at in range(1, len(line)):
            window = line[max(0, at - self.order):at + 1]
            value = self.cache.get(window)
            if value is None:
                if len(self.cache) > 500_000:
                    self.cache.clear()
                value = self.cache[window] = self._difference(window[:-1], window[-1])
            total += value
        return total / (len(line) - 1)


def _scores(strings: dict[str, tuple[int, int]], order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = UrlModel(strings, order)
        for batch in batches:
            scores = [model.score(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield batch.append_column("score", pa.array(scores, pa.float64()))

    return run


def learn_strings(known: DataFrame, order: int = ORDER, min_share: float = MIN_SHARE) -> dict[str, tuple[int, int]]:
    """Counts of the strings of up to order + 1 characters that are in the model. Counted over all
    pages but the unseen; the driver gets what the share admits, which is bounded."""
    counts = known.where("NOT unseen").select("host", "path", "rejected").mapInArrow(
        _strings(order), "string string, rejected long, accepted long").groupBy("string").agg(
        F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted")).withColumn("n", F.length("string"))
    totals = counts.groupBy("n").agg(F.sum("rejected").alias("all_rejected"), F.sum("accepted").alias("all_accepted"))
    shares = counts.join(F.broadcast(totals), "n").where(  # a row for each length
        (F.col("rejected") > F.col("all_rejected") * min_share) | (F.col("accepted") > F.col("all_accepted") * min_share))
    return {r["string"]: (r["rejected"], r["accepted"]) for r in shares.select("string", "rejected", "accepted").collect()}


def judge_urls(pages: DataFrame, rules: dict[str, str] = RULES, suspect: tuple[str, ...] = SUSPECT, order: int = ORDER,
               min_share: float = MIN_SHARE, false_blocks: float = FALSE_BLOCKS, folds: int = 5) -> DataFrame:
    """A verdict for every page: page_id, host, path, rule, verdict, score.

    A listed rule decides where one fits. For other pages the score decides: above the threshold
    means block. Rejected examples are pages that a rule blocks or whose host has a suspect word,
    accepted ones all others. Pages of one fold are not learned from; the threshold is the
    smallest, in thousandths and not below 0, that blocks at most `false_blocks` of its accepted
    pages. A url that is null or has no `://` has empty host and path, score 0 and is allowed. Null
    ids stay null, repeated rows are judged alike, and an empty table gives no rows.
    """
    known = _known(pages, rules, suspect, folds)
    strings = learn_strings(known, order, min_share)
    columns = "page_id long, host string, path string, rule string, listed string, rejected boolean, unseen boolean"
    scored = known.select(F.col("page_id").cast("bigint").alias("page_id"), "host", "path", "rule", "listed", "rejected", "unseen").mapInArrow(
        _scores(strings, order), f"{columns}, score double")
    bins = scored.where("unseen AND NOT rejected").groupBy(F.ceil(F.col("score") * _BINS).alias("bin")).count().collect()
    allowed, threshold = false_blocks * sum(r["count"] for r in bins), 0.0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        allowed -= r["count"]
        if allowed < 0:
            threshold = max(0.0, r["bin"] / _BINS)
            break
    own = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("listed", own).alias("verdict"), "score")
