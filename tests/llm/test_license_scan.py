import re

from siftlake.llm import license_scan as L

APACHE = "Licensed under the Apache License, Version 2.0."
GPL = dict(L.NOTICES[::-1])["gpl"]
LONG = next(text for _, text in L.NOTICES if text.startswith("permission is hereby"))
FILL = "some words that say nothing about rights at all "
TEXTS = [None, "", "...", "MIT license", "mit\nLICENSE mit-license", FILL * 20 + APACHE + FILL * 30, FILL + GPL.replace("and", "and also", 1) + FILL,
         "the general public license and the apache license", LONG.upper() + ", " + LONG, FILL * 9 + LONG.replace("charge", "cost") + FILL * 9,
         "licensed under the acme license", "Licensed under CC BY-NC 4.0.", "permission is hereby granted", "é licensed under the MIT license ü", FILL * 20_000 + APACHE]
BASE = {tuple(p.encode().split()): label for p, label in L.PHRASES.items()}


def plain(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    at = [(i, label) for i in range(len(words)) for phrase, label in BASE.items() if tuple(words[i:i + len(phrase)]) == phrase]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at}))


def scan(documents, texts, **settings):
    return {r["doc_id"]: r for r in L.license_scan(documents([(i, t, "s") for i, t in enumerate(texts)]), **settings).collect()}


def test_base_figures(documents):
    got = scan(documents, TEXTS)
    for i, text in enumerate(TEXTS):
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == plain(text), i
        assert set(filter(None, got[i]["base_labels"].split(","))) <= set(got[i]["labels"].split(","))
        assert 0 <= got[i]["score"] <= 1


def test_notices(documents):
    for limit in (L.BROADCAST_SPANS, 0):
        got = scan(documents, TEXTS, broadcast_spans=limit)
        labels = {i: r["labels"] for i, r in got.items()}
        assert labels == {0: "", 1: "", 2: "", 3: "mit", 4: "mit", 5: "apache", 6: "gpl", 7: "apache,gpl", 8: "mit", 9: "mit", 10: "",
                          11: "cc-by-nc", 12: "", 13: "mit", 14: "apache"}
        assert got[5]["score"] == got[8]["score"] == 1.0 and 0.9 <= got[9]["score"] < 1 and got[3]["score"] == 0.5 and got[10]["score"] == 0


def test_every_notice_finds_itself_and_only_its_kind(documents):
    got = scan(documents, [f"{FILL}{text.title()}. {FILL}" for _, text in L.NOTICES])
    for i, (label, _) in enumerate(L.NOTICES):
        assert label in got[i]["labels"].split(","), label


def test_repeated_rows_null_ids_and_no_rows(documents):
    rows = L.license_scan(documents([(1, APACHE, "s"), (1, APACHE, "s"), (None, APACHE, None), (2, "x", "s")])).collect()
    assert sorted((str(r["doc_id"]), r["labels"], r["score"]) for r in rows) == [("1", "apache", 1.0)] * 2 + [("2", "", 0.0), ("None", "apache", 1.0)]
    assert L.license_scan(documents([])).count() == 0
