import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftlake.llm import decontamination as D


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def grams(ws, k):
    return [tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)]


def plain(docs, items, k=5, percent=80):
    """Every window of the item's size, the long way: (doc_id, item_id) -> similarity, start."""
    out = {}
    for doc_id, text, _ in docs:
        ws = words(text)
        for item_id, item in items:
            target = words(item)
            if not target or not ws:
                continue
            n = min(k, len(target))
            want = Counter(grams(target, n))
            for start in range(max(1, len(ws) - len(target) + 1)):
                have = Counter(grams(ws[start:start + len(target)], n))
                common = sum((have & want).values())
                whole = sum((have | want).values())
                if common and 100 * common >= percent * whole and common / whole > out.get((doc_id, item_id), (0, 0))[0]:
                    out[doc_id, item_id] = common / whole, start
    return out


@pytest.fixture
def benchmark(table):
    return lambda rows: table("item_id long, text string, length int, hash string", [(i, t, 1, "x") for i, t in rows])


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.randint(14, 60)).capitalize() + ".") for i in range(30)]
    items += [(30, None), (31, " .,"), (32, "zeta"), (33, "alpha beta"), (None, text(20)), (34, "go " * 25), (35, items[3][1]), (36, "one two one two one two one two one two")]
    docs = []
    for i, (_, item) in enumerate(items):
        if item and item.strip(" .,"):
            ws = item.split()
            docs.append((100 + i, f"{text(rng.randint(0, 50))} {item} {text(30)}", "s"))
            docs.append((200 + i, f"{text(20)} {' '.join(ws[:len(ws) // 2])} extra {' '.join(ws[len(ws) // 2:])} {text(9)}", "s"))
            docs.append((300 + i, ("\n" + item.upper().replace(" ", " - ")), "s"))
            docs.append((400 + i, " ".join(ws[:-1]), "s"))
            docs.append((500 + i, f"{text(8)} {' '.join(ws[:len(ws) // 2])} {text(30)}", "s"))
    docs += [(1, None, "s"), (2, "", "s"), (3, text(4000) + " " + items[5][1] + " " + text(4000), "s"), (4, text(500), None), (None, items[2][1], "s"),
             (5, items[1][1] + " " + items[1][1], "s"), (5, items[1][1] + " " + items[1][1], "s"), (6, "go " * 60, "s")]
    return docs, items


@pytest.mark.parametrize("row_limit", [D.BROADCAST_ROWS, 0])
def test_items_found_equal_all_windows(documents, benchmark, row_limit):
    docs, items = corpus(1)
    rows = D.contaminated(documents(docs), benchmark(items), row_limit=row_limit).collect()
    got = {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["start"]) for r in rows}
    assert len(rows) == len(got)
    assert got == plain(docs, items)


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        a, b = rng.getrandbits(64), 0
        for bit in rng.sample(range(64), D.RADIUS):
            b |= 1 << bit
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        rows.append((i, signed(a), signed(a ^ b)))
    df = spark.createDataFrame(rows, "i int, a long, b long")
    errors = D.RADIUS // D.BLOCKS
    left, right = df.select("i", "a", D._blocks("a", 0, D.BLOCKS)), df.select("i", "b", D._blocks("b", errors, D.BLOCKS))
    met = left.join(right, ["i", "block", "value"])
    assert met.select("i").distinct().count() == 300
    assert met.where(F.col("block") == D._first_block("a", "b", errors, D.BLOCKS)).groupBy("i").count().where("count <> 1").count() == 0


def test_simhash_bits(spark):
    rng = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    lists = [[rng.getrandbits(64) for _ in range(n)] for n in (1, 2, 7, 40, 3000)]
    df = spark.createDataFrame([(i, [signed(h) for h in hashes]) for i, hashes in enumerate(lists)], "i int, grams array<long>")
    for r in df.select("i", D.simhash("grams").alias("f")).collect():
        hashes = lists[r["i"]]
        want = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
        assert r["f"] == signed(want)


def test_clean_documents(documents, benchmark):
    docs, items = corpus(2)
    held = {i for i, _ in plain(docs, items)}
    for limit in (D.BROADCAST_ROWS, 0):
        clean = D.clean_documents(documents(docs), benchmark(items), row_limit=limit)
        assert clean.columns == documents([]).columns
        assert sorted((str(r["doc_id"]) for r in clean.collect())) == sorted(str(i) for i, _, _ in docs if i not in held)


def test_empty_tables(documents, benchmark):
    docs, items = corpus(3)
    assert D.contaminated(documents([]), benchmark(items)).count() == 0
    assert D.contaminated(documents(docs), benchmark([])).count() == 0
    assert D.clean_documents(documents(docs), benchmark([])).count() == len(docs)


def test_long_items_are_looked_for_in_parts(documents, benchmark, monkeypatch):
    monkeypatch.setattr(D, "MAX_WINDOW", 40)
    long = " ".join(f"p{i}" for i in range(100))
    rows = D.contaminated(documents([(1, "x y z " + long, "s")]), benchmark([(7, long)])).collect()
    assert sorted((r["item_id"], r["part"], r["start"]) for r in rows) == [(7, 0, 3), (7, 1, 43), (7, 2, 83)]


def test_no_python_in_the_plan(documents, benchmark):
    docs, items = corpus(4)
    plan = D.contaminated(documents(docs), benchmark(items))._jdf.queryExecution().toString()
    assert not any(name in plan for name in ("Python", "Pandas", "ArrowEval", "Cartesian"))


def test_an_item_over_the_window_is_judged_as_a_whole(documents, benchmark):
    long = [f"p{i}" for i in range(D.MAX_WINDOW + 1)]
    texts = ["x y z " + " ".join(long), f"one {long[-1]} stands here", " ".join(long[:2000]), " ".join(long[:2000] + ["odd"] + long[2000:])]
    rows = D.contaminated(documents([(i, t, "s") for i, t in enumerate(texts)]), benchmark([(7, " ".join(long))])).where("part = 0").collect()
    n = len(long) - 4
    assert {(r["doc_id"], r["start"], r["n_words"]): r["similarity"] for r in rows} == {
        (0, 3, n + 4): 1.0, (3, 0, n + 4): pytest.approx((n - 5) / (n + 5), abs=1e-3)}


@pytest.mark.parametrize("row_limit", [D.BROADCAST_ROWS, 0])
def test_long_items_found_equal_all_windows(documents, benchmark, monkeypatch, row_limit):
    monkeypatch.setattr(D, "MAX_WINDOW", 12)
    docs, items = corpus(5)
    rows = D.contaminated(documents(docs), benchmark(items), row_limit=row_limit).where("part = 0").collect()
    got = {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["start"]) for r in rows}
    assert len(rows) == len(got)
    assert got == plain(docs, items)
