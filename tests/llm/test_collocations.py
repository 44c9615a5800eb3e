"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from siftlake.llm import collocations as module
from siftlake.llm.collocations import collocations, packed, unpacked


def plain(rows, least, most=2000, percent=100):
    """Rows are (lang, text); the definition, word by word."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, 6):
                    if i + m <= len(words):
                        f[lang, tuple(words[i:i + m])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = Counter()
    for (lang, phrase), a in found.items():
        for m in range(2, len(phrase)):
            for i in range(len(phrase) - m + 1):
                key = lang, phrase[i:i + m]
                covered[key] = max(covered[key], a)
    out = []
    for (lang, phrase), a in found.items():
        if covered[lang, phrase] * 100 >= a * percent:
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = f[lang, phrase[:k]], f[lang, phrase[k:]]
            cuts.append((Fraction(1000 * a * n[lang], left * right).__floor__(), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(phrase), a, left, right, n[lang], score))
    rows = []
    for lang in {r[0] for r in out}:
        of = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        rows += [(lang, i, *r[1:]) for i, r in enumerate(of[:most], 1)]
    return sorted(rows)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["the", "of", "The", "a", "New", "york", "city", "x|y", "é", "É", "\x01", "big", "old"]
    rows = []
    for i in range(300):
        parts = [rng.choice(words) if rng.random() < .7 else "the new york city of" for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(p + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", " ! "]) for p in parts)))
    return rows + [("en", None), (None, ""), ("en", "  \t "), ("en", "..,,"), ("fr", "the new " * 400)]


SCHEMA = "lang string, text string, phrase string, a int, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("least,most,percent", [(1, 10**6, 100), (12, 5, 100), (12, 10**6, 60)])
def test_equals_the_definition(spark, texts, least, most, percent):
    df = collocations(frame(spark, texts), least, most, percent)
    assert found(df) == plain(texts, least, most, percent)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("budget", [40, 400])
def test_small_groups_extend_hot_prefixes(spark, texts, budget, monkeypatch):
    """A budget of 40 suffixes a group: prefixes of one, two, three and all words."""
    monkeypatch.setattr(module, "GATHERED", 500)
    assert found(collocations(frame(spark, texts), 3, group_suffixes=budget)) == plain(texts, 3)


def test_repeated_rows_count_as_often(spark):
    rows = [("en", "one two three")] * 120 + [("en", "one two four")] * 30
    assert [(r["phrase"], r["a"]) for r in collocations(frame(spark, rows)).collect()] == [("one two", 150), ("one two three", 120)]


def test_empty_tables_and_texts(spark):
    assert found(collocations(frame(spark, []))) == []
    assert found(collocations(frame(spark, [("en", None), ("en", ""), (None, None)]), 1)) == []


def test_words_with_one_hash_get_another_seed(spark, texts, monkeypatch):
    """A hash of few values for the first seed: workers get the class by value."""
    real = module.xxhash.xxh64_intdigest
    seeds = []
    plain_words = module._words

    def poor(seed):
        seeds.append(seed)
        if seed:
            return plain_words(seed)

        def run(batches):
            for batch in plain_words(0)(batches):
                column = pa.array(np.full(len(batch), 7))
                yield batch.set_column(2, "code", column)

        return run

    monkeypatch.setattr(module, "_words", poor)
    assert found(collocations(frame(spark, texts[:60]), 5)) == plain(texts[:60], 5)
    assert seeds == [0, 1] and real is module.xxhash.xxh64_intdigest


def test_packing_is_a_round_trip():
    rows = np.random.default_rng(1).integers(1, 1 << 63, (50, 3), dtype=np.uint64)
    assert (unpacked(packed(rows).to_pylist(), 3) == rows).all()
    assert unpacked([], 3).shape == (0, 3)
