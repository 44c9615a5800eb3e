import math
import re
from collections import Counter

import pytest

from siftlake.llm import url_filter as U

URLS = [None, "", "no scheme", "http://", "http://Example.NET", "http://example.net/", "https://www.EXAMPLE.net/en/1?x=1", "x://net/a", "x://notnet/a",
        "http://example.net/EN/2", "http://a.example.com/de/", "http://example.com/de", "http://badexample.com/de/1", "https://a.b.org/fr/1#z",
        "http://org/fr/", "http://example.org/en/1", "http://a://b.net/c", "http://h.net?q=/en/", "http://h.net#/en/", "http://münchen.net/ü", "http://e.com/" + "p" * 20_000]


def plain(url):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = []
    for rule in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


@pytest.fixture
def pages(table):
    def make(urls):
        return table("page_id long, url string, html string, score string, verdict int", [(i, u, "<p>", "s", 1) for i, u in enumerate(urls)])

    return make


def test_hosts_paths_and_rules(pages):
    rows = {r["page_id"]: r for r in U.judge_urls(pages(URLS)).collect()}
    for i, url in enumerate(URLS):
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == plain(url), url
        if rows[i]["rule"]:
            assert rows[i]["verdict"] == U.RULES[rows[i]["rule"]]
        assert rows[i]["verdict"] in ("allow", "block")
    assert all(rows[i]["verdict"] == "allow" and rows[i]["score"] == 0 for i in range(3))


def reference_score(lines, rejected, order, min_share, host, path):
    counts = [Counter(), Counter()]
    for line, bad in zip(lines, rejected):
        counts[not bad].update(line[a:a + n] for n in range(1, order + 2) for a in range(len(line) - n + 1))
    totals = [[sum(v for s, v in c.items() if len(s) == n) for n in range(order + 2)] for c in counts]
    known = {s for c, t in zip(counts, totals) for s, v in c.items() if v > t[len(s)] * min_share}
    line, total = U.START + host + path + U.END, 0.0
    for at in range(1, len(line)):
        logs = []
        for c, t in zip(counts, totals):
            p = 1 / 256
            for n in range(min(order, at) + 1):
                context = line[at - n:at]
                kids = [s for s in known if len(s) == n + 1 and s.startswith(context)]
                if not kids:
                    break
                held = sum(c[s] for s in kids)
                seen = (sum(c[s] for s in known if len(s) == 1) if not n else (c[context] if context in known else 0))
                kinds = sum(c[s] > 0 for s in kids)
                here = context + line[at]
                if max(seen, held) + kinds:
                    p = ((c[here] if here in known else 0) + (kinds + max(0, seen - held)) * p) / (max(seen, held) + kinds)
            logs.append(math.log(p))
        total += logs[0] - logs[1]
    return total / (len(line) - 1)


def test_model_equals_a_direct_computation(spark, pages):
    urls = [f"http://{'spam' if i % 5 == 0 else 'site'}{i % 7}.example.org/en/{i}" for i in range(40)]
    known = U._known(pages(urls), U.RULES, U.SUSPECT, 5)
    rows = known.where("NOT unseen").collect()
    strings = U.learn_strings(known, 3, 1 / 100)
    model = U.UrlModel(strings, 3)
    lines = [U.START + r["host"] + r["path"] + U.END for r in rows]
    for host, path in [("spam1.example.org", "/en/5"), ("site3.example.org", "/en/8"), ("other.com", "/"), ("", "")]:
        want = reference_score(lines, [r["rejected"] for r in rows], 3, 1 / 100, host, path) if host else 0.0
        assert model.score(host, path) == pytest.approx(want, rel=1e-9)


def test_alike_hosts_are_blocked_and_others_left(pages):
    urls = [f"http://{'casino-win' if i % 10 == 0 else 'reading-room'}{i % 3}.example.org/en/{i}" for i in range(600)]
    rows = {r["page_id"]: r["verdict"] for r in U.judge_urls(pages(urls)).collect()}
    assert all(rows[i] == ("block" if i % 10 == 0 else "allow") for i in rows)
    assert len(rows) == 600


def test_model_is_bounded(pages):
    urls = [f"http://h{i}.example.org/{i * 7919}" for i in range(500)]
    strings = U.learn_strings(U._known(pages(urls), U.RULES, U.SUSPECT, 5), 5, 1 / 50)
    assert len(strings) <= 2 * 6 * 50


def test_empty_table(pages):
    assert U.judge_urls(pages([])).count() == 0
