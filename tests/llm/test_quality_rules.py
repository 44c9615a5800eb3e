import re

from siftlake.llm import quality_rules as Q

CLEAN = " ".join(f"word{i % 71} other{i % 67} thing{i}" for i in range(40)) + "."


def plain(text):
    """The documented figures, counted the long way."""
    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    marked = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search("[^ \t-\r]", line)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": sum(line in lines[:i] for i, line in enumerate(lines)), "n_repeat_words": len(marked)}


TEXTS = [None, "", " \t\n\r", "one", "a b c a b c a b c", "x y\nx y\n\n \nx y", "é|ü <b> #1\x0b漢字 50%\x0c$", CLEAN,
         CLEAN + "\n" + CLEAN, "a b a b a b a", "## " * 200, CLEAN.upper() + "!!", " | ".join(CLEAN.split()), "z" * 300_000,
         "\n".join(["same line here"] * 60), "1 2 3 " * 40, CLEAN]


def test_base_figures(documents):
    got = {r["doc_id"]: r for r in Q.quality_rules(documents([(i, t, "s") for i, t in enumerate(TEXTS)])).collect()}
    for i, text in enumerate(TEXTS):
        want = plain(text)
        assert {k: got[i][k] for k in want} == want, i
        assert got[i]["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_clean_text_stays_and_junk_goes(documents):
    junk = [" ".join(w + "###" for w in CLEAN.split()), " | ".join(CLEAN.split()), CLEAN.upper(),
            "!! ".join(CLEAN.split()), "\n".join([CLEAN] + ["a long line that is said again"] * 90), "x1" * 2000]
    rows = [(i, t, "s") for i, t in enumerate([CLEAN, *junk])]
    kept = {r["doc_id"]: r["kept"] for r in Q.quality_rules(documents(rows)).collect()}
    assert kept == {0: True, **{i: False for i in range(1, len(rows))}}


def test_order_changes_no_verdict(documents):
    docs = documents([(i, t, "s") for i, t in enumerate(TEXTS)])
    names = [rule.name for rule in Q.RULES]
    verdicts = [sorted((r["doc_id"], r["kept"]) for r in Q.quality_rules(docs, order=o).collect()) for o in (names, names[::-1])]
    assert verdicts[0] == verdicts[1]
    assert sorted(Q.cascade_order(docs)) == sorted(names)


def test_a_rejected_text_is_not_shown_to_later_rules(documents):
    def boom(_):
        raise ValueError("a rule behind a rejection was asked")

    rules = (Q.Rule("all", lambda d: True), Q.Rule("never", boom))
    assert not Q.quality_rules(documents([(1, CLEAN, "s")]), rules, ["all", "never"]).first()["kept"]


def test_accepted_documents_keep_their_columns(documents):
    docs = documents([(1, CLEAN, "s"), (2, None, None), (None, CLEAN, None), (1, CLEAN, "s")])
    got = Q.accepted_documents(docs)
    assert got.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "1", "None"]


def test_empty_table(documents):
    assert Q.quality_rules(documents([])).count() == 0
    assert Q.accepted_documents(documents([])).count() == 0
