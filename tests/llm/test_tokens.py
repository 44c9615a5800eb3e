import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftlake.llm import token_counts as C
from siftlake.llm import token_files as T

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " \n\t", "Hello, world!", "déf, It's THE<|endoftext|>x áb,c 'S ſ İstanbul ǅ, 12.5  x\x1c y\x85z é,́ …,. \t\n",
         "ΣΑΣ, ὈΔΥΣΣΕΎΣ. ﬁ? 漢字!かな; a'll! don't. it's; 'll", "word " * 30_000, "Hello, world!", "a\r\n\nb  \n 😀 ç\n", "x" * 5000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def expected(tokenizer, rows):
    out, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(row):
    return (row[1], str(row[0]))


@pytest.mark.parametrize("block", [T.BLOCK_WORDS, 7])
def test_files_hold_what_the_tokenizer_gives(documents, tokenizer, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK_WORDS", block)  # in this process only; results agree at any size
    rows = [(50 - 3 * i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "no id", "s"), (2, "twice", "s"), (2, "twice", "s")]
    got = T.token_output(documents(rows), WORDS).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(tokenizer, rows), key=key)


@pytest.mark.parametrize("block, entries", [(7, 10), (100_000, 1_000_000), (3, 3)])
def test_encoder_at_any_cache_size(tokenizer, monkeypatch, block, entries):
    monkeypatch.setattr(T, "BLOCK_WORDS", block)
    monkeypatch.setattr(T, "CACHE_ENTRIES", entries)
    encoder, at = T.WordEncoder(WORDS, "<u4"), 0
    texts = [(t or "") for t in TEXTS]
    parts = []
    for part, ended in encoder.encode_texts(t.encode() for t in texts):
        parts.append(part)
        if ended:
            assert np.frombuffer(b"".join(parts), "<u4").tolist() == tokenizer.encode(texts[at], add_special_tokens=False).ids
            parts, at = [], at + 1
    assert at == len(texts)


def test_random_strings_with_marks_and_punctuation(tokenizer):
    rng = random.Random(8)
    signs = ["a", "B", "İ", "ß", "é", "e\u0301", "\u0301", "\u0307", "ǅ", "Σ", "ﬁ", "漢", "1", "'", "'s", "?", ".", ",", "!?", " ", " ", "\t", "\u00a0",
             "<|endoftext|>", "|", "😀", "\u200d", "ſ"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 9))) for _ in range(60_000)] + ["İ?", "xİ.", "ÍİI;"]
    encoder = T.WordEncoder(WORDS, "<u4")
    got = [np.frombuffer(part, "<u4").tolist() for part, _ in encoder.encode_texts(t.encode() for t in texts)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_another_tokenizer_encodes_whole_texts(documents):
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert T.encodes_by_words(WORDS) and not T.encodes_by_words(other)
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    got = T.token_output(documents(rows), other).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(Tokenizer.from_file(other), rows), key=key)


def test_rows_without_id_spread_over_shards(spark, documents, tmp_path):
    docs = documents([(None if i % 2 else i, f"text number {i} " * 40, "s") for i in range(3000)])
    folder = f"file://{tmp_path}/out"
    T.write_token_files(docs, folder, WORDS, 2)
    shards = T.token_shards(spark, folder).collect()
    assert max(s["docs"] for s in shards) < 1500 if len(shards) > 2 else len(shards) >= 1
    rows = T.read_token_files(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None] * 1500 + list(range(0, 3000, 2))


def test_files_are_flat_and_mapped(spark, documents, tmp_path):
    docs = documents([(i, f"text number {i}", "s") for i in range(100)])
    folder = f"file://{tmp_path}/out"
    T.write_token_files(docs, folder, WORDS, 2)
    shards = T.token_shards(spark, folder).orderBy("shard").collect()
    assert [s["start"] for s in shards] == [sum(x["tokens"] for x in shards[:i]) for i in range(len(shards))]
    for s in shards:
        ids = np.memmap(f"{tmp_path}/out/part-{s['shard']:06d}.bin", "<u2", "r") if s["tokens"] else []
        offsets = np.fromfile(f"{tmp_path}/out/part-{s['shard']:06d}.idx", "<u8")
        assert len(ids) == s["tokens"] == offsets[-1] and len(offsets) == s["docs"] + 1
    ids = np.concatenate([np.fromfile(f"{tmp_path}/out/part-{s['shard']:06d}.doc", "<i8") for s in shards])
    assert ids.tolist() == list(range(100))
    assert not list(tmp_path.glob("out/_attempt*"))


def test_empty_table_of_texts(documents):
    assert T.token_output(documents([]), WORDS).count() == 0


def brute(text, rule, tokenizer):
    sections, start = [], 0
    for line in text.split("\n"):
        sections.append((start, start + len(line) + 1))
        start += len(line) + 1
    sections[-1] = (sections[-1][0], len(text))
    if len(sections) > 1 and sections[-1][0] == len(text):
        sections.pop()
    counts = [0] * len(sections)
    for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
        shares = [max(0, min(b, hi) - max(a, lo)) for lo, hi in sections]
        touched = [i for i, s in enumerate(shares) if s]
        counts[{"first": touched[0], "last": touched[-1], "most": shares.index(max(shares))}[rule]] += 1
    return [(i, lo, hi - lo, n) for i, ((lo, hi), n) in enumerate(zip(sections, counts))]


@pytest.mark.parametrize("rule", C.RULES)
def test_sections_equal_offsets_of_the_other_library(documents, rule):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    texts = [t for t in TEXTS if t is None or len(t) < 10_000] + ["\n\n\n  \n\n x\n\n", "\n", "é\n漢字 x\n\n", "a \n\n\n\n b", "no feed at the end\nlast"]
    got = {}
    for r in C.section_tokens(documents([(i, t, "s") for i, t in enumerate(texts)]), RANKS, public_tokenizers.PATTERN, rule).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["n_chars"], r["n_tokens"]))
    for i, text in enumerate(texts):
        assert sorted(got[i]) == brute(text or "", rule, whole), (i, rule)


def test_section_edge_cases(documents):
    with pytest.raises(ValueError):
        C.section_tokens(documents([]), RANKS, public_tokenizers.PATTERN, "middle")
    assert C.section_tokens(documents([]), RANKS, public_tokenizers.PATTERN).count() == 0
    rows = C.section_tokens(documents([(None, "a\nb", None), (1, "a", "s"), (1, "a", "s")]), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["section"], r["n_tokens"]) for r in rows)[:2] == [("1", 0, 1), ("1", 0, 1)] and len(rows) == 4
