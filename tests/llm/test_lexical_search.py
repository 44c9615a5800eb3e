"""Lexical search against the scoring formula on every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftlake.llm import lexical_search as module
from siftlake.llm.lexical_search import Trie, lexical_search, part

SPLIT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(SPLIT, lowered)


def plain(docs, items, k=10):
    lists = [(i, terms(t)) for i, t in docs]
    n_docs, n_words = sum(bool(ts) for _, ts in lists), sum(len(ts) for _, ts in lists)
    df = Counter(t for _, ts in lists for t in set(ts))
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, asked in wanted.items():
        scored = []
        for doc, ts in lists:
            if not ts:
                continue
            tf, m = Counter(ts), 10 + 90 * len(ts) * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in asked if tf[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if gone else doc, -minus) for rank, (minus, gone, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["é", "É", "naïve", "A1", "a1", "東京"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", ", ", "-"]).join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(90)] + [(None, docs[7][1]), (None, docs[9][1]), (3, docs[3][1])]
    docs += [(2000, None), (2001, ""), (2002, " .,\t"), (2003, "w1 " * 3000)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words + ["unknown"], k=rng.randint(1, 12)))) for i in range(25)]
    return docs, items + [(100, None), (101, "..."), (102, "nothing here"), (5, "w1 w1 W1"), (None, "w3 w4"), (103, docs[0][1] or "w2")]


def run(spark, docs, items, **settings):
    docs = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, rank int").repartition(4)
    items = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, term string")
    found = lexical_search(docs, items, **settings)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("settings", [{}, {"k": 3, "block_terms": 40}])
def test_equals_the_formula(spark, corpus, settings):
    assert run(spark, *corpus, **settings) == plain(*corpus, settings.get("k", 10))


def test_small_tries(spark, corpus, monkeypatch):
    monkeypatch.setattr(module, "TRIE_TERMS", 300)
    assert run(spark, *corpus) == plain(*corpus)


def test_empty_tables(spark, corpus):
    assert run(spark, [], corpus[1]) == []
    assert run(spark, corpus[0], []) == []
    assert run(spark, [(1, None)], corpus[1]) == []


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold_and_search_skips_documents(seed, monkeypatch):
    monkeypatch.setattr(module, "LEAF", 4)
    rng = np.random.default_rng(seed)
    n, n_terms = 300, 40
    docs = [np.unique(rng.zipf(1.4, rng.integers(1, 12)) % n_terms) for _ in range(n)]
    docs[50:120] = [docs[50]] * 70
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    flat = np.concatenate([rng.permutation(d) for d in docs])
    tfs, norms = rng.integers(1, 9, len(flat)), rng.integers(10, 300, n)
    trie = Trie(starts, flat, tfs, norms, n_terms)
    parts = part(tfs.astype(np.int64), np.repeat(norms, np.diff(starts)))
    item = np.unique(rng.integers(0, n_terms, 6))
    weights = rng.integers(1, 900, len(item))
    dense = np.zeros(n_terms, np.int64)
    dense[item] = weights
    scores = np.add.reduceat(dense[flat] * parts, starts[:-1])
    assert sorted(trie.docs) == list(range(n))
    leaves = np.zeros(n, int)
    for node in range(len(trie.low)):
        inside = trie.docs[trie.low[node]:trie.high[node]]
        assert trie.upper(np.array([node]), item, weights)[0] >= scores[inside].max()
        if not trie.children[node]:
            leaves[inside] += 1
        else:
            below = trie.child[node] + np.arange(trie.children[node])
            assert trie.low[below[0]] == trie.low[node] and trie.high[below[-1]] == trie.high[node]
    assert (leaves == 1).all()
    found = trie.search(item, weights, 10, [], lambda doc: (False, int(doc)))
    want = sorted((-s, i) for i, s in enumerate(scores) if s > 0)[:10]
    assert [(-s, key[1]) for s, key in found] == want
