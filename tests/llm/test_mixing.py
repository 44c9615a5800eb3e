import hashlib
from collections import defaultdict

import pytest

from siftlake.llm import mixing as M


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Give out the budget by weight, hold what is above its limit, and share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in held)
        free = [s for s in names if s not in held]
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target | {s: most * sizes[s] for s in held}
        held |= above


def plain_taken(rows):
    groups, sizes = defaultdict(list), defaultdict(int)
    for doc_id, text, source in rows:
        n = len((text or "").encode().split())
        h = int(hashlib.md5((str(doc_id) if doc_id is not None else "").encode()).hexdigest()[:10], 16)
        groups[source].append((h, n))
        sizes[source] += n
    out = {}
    for source, target in plain_targets(sizes).items():
        copies = int(target // sizes[source]) if sizes[source] else 0
        rest, below = target - copies * sizes[source], 0
        taken = defaultdict(int)
        for h in sorted({h for h, _ in groups[source]}):
            words = sum(n for k, n in groups[source] if k == h)
            if below + words > rest:
                taken[h] = below + words - rest < rest - below
                break
            taken[h] = 1
            below += words
        out[source] = target, {(h, n): n * (copies + taken[h]) for h, n in groups[source]}
    return sizes, out


def rows_of(n):
    rows = [(i, "w " * (i * 7 % 40), ["big", "b", "C", "é", None, "z"][0 if i % 3 == 0 else i % 6]) for i in range(n)]
    return rows + [(5, rows[5][1], rows[5][2]), (None, "a b", "b"), (7000, None, "b"), (7001, "", "empty"), (7002, "x " * 5000, "z")]


@pytest.mark.parametrize("broadcast_sources", [M.BROADCAST_SOURCES, 0])
def test_mix_equals_plain_version(documents, broadcast_sources):
    rows = rows_of(400)
    sizes, want = plain_taken(rows)
    got = M.mix_sources(documents(rows), broadcast_sources=broadcast_sources).collect()
    assert len(got) == len(rows)
    source_of = {i: s for i, _, s in rows}
    for r in got:
        source = source_of[r["doc_id"]]
        h = int(hashlib.md5((str(r["doc_id"]) if r["doc_id"] is not None else "").encode()).hexdigest()[:10], 16)
        assert r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source][0], rel=1e-12)
        assert r["taken"] == want[source][1][h, r["size"]] <= 2 * r["size"]


def test_targets_hold_their_limits(documents):
    rows = rows_of(300)
    got = M.mix_sources(documents(rows)).collect()
    per = {r["source_size"]: r["target"] for r in got}
    assert sum(per.values()) == pytest.approx(1.5 * sum(per))
    assert all(target <= 2 * size + 1e-9 for size, target in per.items())


def test_reruns_agree_and_documents_follow(documents):
    docs = documents(rows_of(200))
    first, second = ({(r["doc_id"], r["size"], r["taken"]) for r in M.mix_sources(docs).collect()} for _ in range(2))
    assert first == second
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for doc_id, size, taken in first:
        if size and doc_id not in (5, None):
            assert times.get(doc_id, 0) * size == taken


def test_larger_share_keeps_what_a_smaller_one_took(documents):
    docs = documents([(i, "w " * 10, "one") for i in range(300)])
    small, large = ({r["doc_id"] for r in M.mix_sources(docs, share=s).where("taken > 0").collect()} for s in (0.3, 0.6))
    assert small < large


def test_empty_and_wordless_tables(documents):
    assert M.mix_sources(documents([])).count() == 0
    assert M.mixed_documents(documents([])).count() == 0
    assert [(r["size"], r["target"], r["taken"]) for r in M.mix_sources(documents([(1, None, "a"), (2, " ", None)])).collect()] == [(0, 0.0, 0)] * 2


def test_no_python_in_the_plan(documents):
    plan = M.mix_sources(documents(rows_of(20)))._jdf.queryExecution().toString()
    assert not any(name in plan for name in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_rows_without_id_are_told_apart(documents):
    """A third of the rows have no id: the target is met within one document all the same."""
    rows = [(None if i % 3 == 0 else i, f"{i} " + "w " * (i % 9), "one" if i % 2 else "two") for i in range(1500)]
    got = M.mix_sources(documents(rows), share=0.72).collect()
    for size in {r["source_size"] for r in got}:
        own = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
