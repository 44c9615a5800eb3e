import random

import pytest

from siftlake.llm import near_dup as N


def plain(rows, k, percent):
    """Components by comparing all pairs of sets; rows with one doc_id are one document."""
    sets = []
    for doc_id, text, _ in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset())
    label = {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, _, _) in enumerate(rows):
        for b in range(a):
            j = rows[b][0]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((find(i), find(j)))
                label[hi] = lo
    return [(i, len(s), find(i) if i is not None else None) for (i, _, _), s in zip(rows, sets)]


def family(rng, base, n, start, edits):
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        out.append((start + i, " ".join(words), "s"))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    base = rng.choices(words, k=120)
    passage = rng.choices(words, k=60)
    rows = family(rng, base, 60, 100, 8)  # near copies that drift apart
    rows += [(300 + i, " ".join(passage + rng.choices(words, k=25)), "s") for i in range(30)]  # a passage in many texts
    rows += [(400 + i, " ".join(base), "s") for i in range(40)]  # exact copies
    rows += [(500 + i, " ".join(rng.choices(words, k=rng.randint(1, 60))), "s") for i in range(30)]
    rows += [(600, None, "s"), (601, "", "s"), (602, " \t\n", "s"), (603, "Alone", "s"), (604, "aLONE", None), (605, "ALONE\x0c", "s"),
             (606, "one two", "s"), (607, "one two three", "s"), (608, "one TWO", "s"), (None, "one two", "s"), (None, None, None),
             (606, " ".join(passage), "s"), (606, "one two", "s"), (609, " ".join(passage), "s"), (610, " ".join(words * 200), "s")]
    return rows


@pytest.mark.parametrize("k, percent, seed", [(4, 80, 1), (5, 80, 2), (4, 90, 3)])
def test_components_equal_all_pairs(documents, k, percent, seed):
    rows = corpus(seed)
    got = N.near_duplicates(documents(rows), k, percent).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(plain(rows, k, percent), key=key)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_every_pair_within_the_distance_shares_a_key(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        first = [rng.randrange(1 << 16) for _ in range(N.SYMBOLS)]
        second = list(first)
        for at in rng.sample(range(N.SYMBOLS), 15):
            second[at] ^= 1
        rows.append((i, first, second))
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>")
    from pyspark.sql import functions as F
    assert df.where(F.size(F.array_intersect(N.bucket_keys(F.col("a")), N.bucket_keys(F.col("b")))) == 0).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(199, 150), (150, 151)]
    links = [pair if rng.random() < 0.5 else pair[::-1] for pair in links]
    got = {r["node"]: r["label"] for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 150: 150, 151: 150, 199: 150}


def test_one_document_of_each_group_stays(documents):
    rows = corpus(7)
    docs = documents(rows)
    kept = N.distinct_documents(docs, 5, 80)
    assert kept.columns == docs.columns
    component = {(i, c) for i, _, c in plain(rows, 5, 80)}
    ids = [r["doc_id"] for r in kept.collect()]
    assert {i for i in ids if i is not None} == {i for i, c in component if i is not None and i == c}
    assert ids.count(None) == 2


def test_empty_table(documents):
    assert N.near_duplicates(documents([])).count() == 0
    assert N.distinct_documents(documents([])).count() == 0


def test_a_long_chain_in_id_order_takes_few_rounds(spark, monkeypatch):
    rounds = []
    roots = N._roots
    monkeypatch.setattr(N, "_roots", lambda hooks: rounds.append(1) or roots(hooks))
    df = spark.range(1000).selectExpr("id AS a", "id + 1 AS b")
    got = N.components(df).groupBy("label").count().collect()
    assert [tuple(r) for r in got] == [(0, 1001)] and len(rounds) <= 12
    mixed = spark.range(1000).selectExpr("(id * 7919) % 1009 AS a", "((id + 1) * 7919) % 1009 AS b")
    assert N.components(mixed).groupBy("label").count().count() == 1 and len(rounds) <= 24
    assert N.components(df.where("a < 0")).count() == 0
