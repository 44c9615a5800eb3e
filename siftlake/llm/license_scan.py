"""License notices by diagonal voting.

Every rolling word k-gram of every text is joined to the positions of the notices that have it.
A notice that stands in a text gives matches with one and the same offset between text and notice
(a diagonal); a word more or less moves the rest to a neighbouring diagonal. Matches are counted
by diagonal, neighbouring diagonals of one place are merged to a span, and a span with enough
votes is compared with the notice word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import WordHashes, byte_texts, gram_hashes, stored

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The wording of public license notices, as lower-case words.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
GRAM = 3
#: Diagonals this close are one notice with words added or lost, if their places touch as well.
NEIGHBOUR = 3
#: Share of a notice's k-grams that must vote for a span, and of its words that must stand in it.
VOTES = 0.3
SIMILAR = 0.9
#: A row of a span is under 100 bytes; up to so many (100 MB) are broadcast, else both sides are shuffled.
BROADCAST_SPANS = 1_000_000

_TO_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def license_words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and anything beyond ASCII, A-Z lower-cased."""
    return text.translate(_TO_WORDS).split()


def _keyed(documents: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("row_key"))


def _rolling(k: int, block: int = 500_000):
    schema = pa.schema([("row_key", pa.int64()), ("at", pa.int32()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            keys, grams, held = [], [], 0
            for key, text in zip(batch.column("row_key").to_pylist(), byte_texts(batch.column("text"))):
                found = gram_hashes(cache.of(license_words(text)), k)
                keys.append(key)
                grams.append(found)
                held += len(found)
                if held >= block:
                    yield rows(keys, grams)
                    keys, grams, held = [], [], 0
            if held:
                yield rows(keys, grams)

    def rows(keys: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(g) for g in grams]
        places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, np.int64), sizes)), pa.array(places),
                                           pa.array(np.concatenate(grams).view(np.int64))], schema=schema)

    return run


def notice_positions(spark, notices: list[tuple[str, str]], k: int) -> DataFrame:
    """(notice, place, hash) of every k-gram of every notice: one row a word of the notices."""
    cache = WordHashes()
    rows = [(n, at, int(h)) for n, (_, text) in enumerate(notices)
            for at, h in enumerate(gram_hashes(cache.of(license_words(text.encode())), k).view(np.int64))]
    return spark.createDataFrame(rows, "notice int, place int, hash long")


def candidate_spans(documents: DataFrame, notices: list[tuple[str, str]], k: int = GRAM) -> DataFrame:
    """Places of texts that may hold a notice: row_key, notice, first, last (words) and votes.

    The positions are broadcast: they are as large as the notices, which come with the call. Votes
    are counted by diagonal before anything is shuffled. A diagonal meets each position of a notice
    once, so it is one stretch, no longer than the notice, however often the text repeats it.
    """
    grams = _keyed(documents).select("row_key", "text").mapInArrow(_rolling(k), "row_key long, at int, hash long")
    positions = notice_positions(documents.sparkSession, notices, k)
    lengths = positions.groupBy("notice").agg(F.count("*").alias("grams"))
    matches = grams.join(F.broadcast(positions), "hash").select("row_key", "notice", (F.col("at") - F.col("place")).alias("diagonal"), "at", "place")
    diagonals = matches.groupBy("row_key", "notice", "diagonal").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count_distinct("place").alias("votes"))
    order = Window.partitionBy("row_key", "notice").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOUR).cast("int")
    merged = diagonals.withColumn("new", F.coalesce(apart, F.lit(1))).withColumn("span", F.sum("new").over(order))
    spans = merged.groupBy("row_key", "notice", "span").agg(
        F.min("first").alias("first"), (F.max("last") + (k - 1)).alias("last"), F.sum("votes").alias("votes"))
    enough = spans.join(F.broadcast(lengths), "notice").where(F.col("votes") >= F.greatest(F.lit(1), F.ceil(F.col("grams") * VOTES)))
    return enough.select("row_key", "notice", "first", "last", "votes")


def _similarity(words: list[bytes], notice: list[bytes]) -> float:
    """Share of the notice's words that stand in the span in their order."""
    if len(words) == len(notice) and words == notice:
        return 1.0
    matcher = SequenceMatcher(None, words, notice, autojunk=False)
    return sum(m.size for m in matcher.get_matching_blocks()) / len(notice)


def _report(notices: list[tuple[str, str]], phrases: dict[str, str], similar: float):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
    notice_words = [license_words(text.encode()) for _, text in notices]
    starts = defaultdict(list)
    for phrase, label in phrases.items():
        words = license_words(phrase.encode())
        starts[words[0]].append((words, label))
    heads = list(starts)

    def places(words: list[bytes]) -> list[tuple[int, str]]:
        found = []
        for head in heads:
            at = -1
            for _ in range(words.count(head)):
                at = words.index(head, at + 1)
                found += [(at, label) for phrase, label in starts[head] if words[at:at + len(phrase)] == phrase]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text")), batch.column("spans").to_pylist()):
                words = license_words(text)
                base = places(words)
                labels, score = {label for _, label in base}, 0.5 if base else 0.0
                for span in spans or ():
                    notice = notice_words[span["notice"]]
                    slack = min(NEIGHBOUR, len(notice) // 4)
                    near = _similarity(words[max(0, span["first"] - slack):span["last"] + 1 + slack], notice)
                    if near >= similar:
                        labels.add(notices[span["notice"]][0])
                        score = max(score, min(1.0, near))
                at = [place for place, _ in base]
                rows.append((doc_id, len(words), len(base), min(at, default=None), max(at, default=None),
                             ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)), score))
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def license_scan(documents: DataFrame, notices: list[tuple[str, str]] = NOTICES, phrases: dict[str, str] = PHRASES,
                 similar: float = SIMILAR, broadcast_spans: int = BROADCAST_SPANS) -> DataFrame:
    """License phrases and notices of every whole text: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score.

    The base is the places where a phrase's words stand consecutively. `labels` adds those of
    verified notices; `score` is the best verified similarity, 0.5 for a phrase alone, 0 for
    nothing. Null and empty texts have no words, no labels and null places. Repeated rows report
    alike; a null doc_id is reported as null; an empty table gives no rows.
    """
    spans = stored(candidate_spans(documents, notices).distinct())
    lists = spans.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("notice", "first", "last"))).alias("spans"))
    lists = F.broadcast(lists) if spans.count() <= broadcast_spans else lists
    rows = _keyed(documents).join(lists, "row_key", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_report(notices, phrases, similar),
                           "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                           "labels string, score double")
