"""Collocations: phrases counted in depth-truncated suffix subtrees, built group by group.

Every word occurrence starts a suffix, cut after DEPTH words. The suffixes are partitioned
vertically by their first words: prefixes that hold more suffixes than a share of a group are
extended by a word, and prefixes are dealt into groups whose number follows from a memory budget.
A group is one task's work, independent of all others: its suffixes are sorted, which lays out
the subtree of each prefix, and the total below a node is the count of its phrase. Suffixes
travel as one packed block per task and group.

A phrase is no more frequent than its parts. So subtrees grow in rounds, pairs and triples first,
then the deeper levels below frequent triples: suffixes end before a word, a pair or a triple
that is rarer than the threshold. These tests go through bitmaps of a fixed size, which let some
others pass but none fail.

Words stand as 64-bit hashes while they are counted. The hash is checked over the whole
vocabulary, and another seed is taken where two words share one, so counts are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import CACHE_WORDS, written

DEPTH = 5
#: Depth of the first round of subtrees; the second one goes on to DEPTH.
FIRST_DEPTH = 3
#: Suffixes (distinct in their task) that one group holds about.
GROUP_SUFFIXES = 1_000_000
#: A prefix with more than this share of a group is extended by a word.
PREFIX_SHARE = 8
#: Word occurrences a task gathers before it counts them.
GATHERED = 4_000_000
#: Bits of the bitmaps of frequent words and pairs, whatever their number.
BITS = 1 << 24
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_AS_WORDS = bytes.maketrans(_PIECE_ENDS, b" " * len(_PIECE_ENDS))
_AS_STOPS = bytes.maketrans(_PIECE_ENDS, b"." * len(_PIECE_ENDS))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """64-bit code of each word of one language; 0 is the end of a piece."""

    def __init__(self, lang: bytes, seed: int):
        super().__init__({b".": 0})
        self.seed = xxhash.xxh64_intdigest(lang, seed)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
            self[b"."] = 0
        code = self[word] = self.code(word)
        return code

    def code(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word, self.seed)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    columns = (batch.column(name).cast(pa.binary()).to_pylist() for name in ("lang", "text"))
    return ((lang, text) for lang, text in zip(*columns, strict=True) if text)


def _words(seed: int):
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("code", pa.int64()), ("part", pa.binary()), ("f", pa.int64())])

    def table(counts: dict[bytes, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            codes = _Codes(lang, seed)
            coded = np.fromiter((codes.code(w) for w in found), np.uint64, len(found))
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(found), pa.binary()).cast(pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()),
                pa.array(coded.view(np.int64)), packed(coded[:, None]), pa.array(list(found.values()), pa.int64())],
                schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, Counter] = {}
        for batch in batches:
            for lang, text in _texts(batch):
                counts.setdefault(lang, Counter()).update(text.lower().translate(_AS_WORDS).split())
                if len(counts[lang]) > CACHE_WORDS:
                    yield from table({lang: counts.pop(lang)})
        yield from table(counts)

    return run


def _code_runs(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[np.ndarray]:
    """Codes of the words of many texts on end, with 0 between pieces."""
    caches: dict[bytes, _Codes] = {}
    parts, size = [], 0
    for batch in batches:
        for lang, text in _texts(batch):
            words = text.lower().translate(_AS_STOPS).replace(b".", b" . ").split()
            codes = caches.setdefault(lang, _Codes(lang, seed))
            parts.append(np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)))
            parts.append(np.zeros(1, np.uint64))
            size += len(words) + 1
            if size >= GATHERED:
                yield np.concatenate(parts)
                parts, size = [], 0
        if len(caches) > 64:
            caches.clear()
    if parts:
        yield np.concatenate(parts)


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first * _MIX) ^ second
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class Bitmap:
    """A fixed number of bits, set for the hashes of a table; tests never miss one of them."""

    def __init__(self, hashes: DataFrame, column: str):
        place = F.col(column).bitwiseAND(F.lit(BITS - 1))
        found = hashes.select(place.alias("place")).groupBy(F.shiftright("place", 6).cast("int").alias("at")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % 64).cast("int"))).alias("bits"))
        rows = found.toArrow()  # at most BITS / 64 rows
        self.words = np.zeros(BITS // 64, np.int64)
        self.words[rows["at"].to_numpy()] = rows["bits"].to_numpy()

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes & np.uint64(BITS - 1)).astype(np.int64)
        return (self.words[place >> 6] >> (place & 63) & 1).astype(bool)


def _runs(codes: np.ndarray, words: Bitmap, longer: list[Bitmap]) -> np.ndarray:
    """For each place, whether the frequent words there and next to it are one phrase that passes
    all tests: as many words as there are bitmaps of `longer` and one more."""
    fine = words.has(codes) & (codes != 0)
    keys = codes
    for more, bitmap in enumerate(longer, 1):
        keys = _pair_keys(keys[:-1], codes[more:])
        fine = fine[:-1] & fine[1:]
        fine[fine] = bitmap.has(keys[fine])
    return fine


def _pairs(seed: int, words: Bitmap):
    schema = pa.schema([("pair", pa.int64()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in _code_runs(batches, seed):
            fine = _runs(codes, words, [])
            found, counts = np.unique(_pair_keys(codes[:-1], codes[1:])[fine[:-1] & fine[1:]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], schema=schema)

    return run


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of codes as binary values, 8 bytes a word."""
    width, data = 8 * rows.shape[1], np.ascontiguousarray(rows, "<u8").tobytes()
    offsets = (np.arange(len(rows) + 1, dtype=np.int64) * width).tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def unpacked(values: list[bytes], words: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u8").reshape(-1, words)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of phrases of FIRST_DEPTH words, with their counts."""
    for batch in batches:
        key = _prefix_keys(unpacked(batch.column("phrase").to_pylist(), FIRST_DEPTH))[-1]
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("a")], ["key", "f"])


def _suffixes(seed: int, words: Bitmap, longer: list[Bitmap], heavy: list[Bitmap], groups: int, least_words: int, depth: int):
    """Suffixes of `least_words` to `depth` words, equal ones of a stretch of text counted: one
    block for each group and number of words by which its prefixes were dealt."""
    schema = pa.schema([("group", pa.int32()), ("prefix_words", pa.int32()), ("suffixes", pa.binary()), ("counts", pa.binary())])

    def found(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a suffix begins, as rows of codes filled up with 0, and how many each stands for."""
        fine = np.concatenate([_runs(codes, words, longer), np.zeros(depth + len(longer), bool)])
        begins = fine[:len(codes)].copy()
        for further in range(least_words - 1 - len(longer)):
            begins &= fine[further + 1:further + 1 + len(codes)]
        at = np.flatnonzero(begins)
        rows, going = np.zeros((len(at), depth), np.uint64), np.ones(len(at), bool)
        for d in range(depth):
            if d > len(longer):  # the first words belong to the phrase at the place itself
                going = going & fine[at + d - len(longer)]
            rows[going, d] = codes[at[going] + d]
        rows = rows[np.argsort(_prefix_keys(rows)[-1], kind="stable")]
        # Equal rows stand together; different rows with one key are never merged.
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        return rows[new], np.diff(np.append(np.flatnonzero(new), len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in _code_runs(batches, seed):
            rows, counts = found(codes)
            if not len(rows):
                continue
            keys = _prefix_keys(rows)
            prefix, chosen = np.ones(len(rows), np.int64), keys[0].copy()
            extends = np.ones(len(rows), bool)
            for d, bitmap in enumerate(heavy, 1):
                extends[extends] = bitmap.has(keys[d - 1][extends])
                prefix[extends] = d + 1 if d < len(heavy) else depth
                chosen[extends] = keys[d if d < len(heavy) else depth - 1][extends]
            group = ((chosen ^ (chosen >> np.uint64(32))) * _MIX >> np.uint64(33)).astype(np.int64) % groups
            order = np.lexsort((prefix, group))
            group, prefix, rows, counts = group[order], prefix[order], rows[order], counts[order]
            new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (prefix[1:] != prefix[:-1])))
            blocks = [(rows[a:b].astype("<u8").tobytes(), counts[a:b].astype("<i8").tobytes()) for a, b in zip(new, [*new[1:], len(rows)], strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(group[new], pa.int32()), pa.array(prefix[new], pa.int32()),
                pa.array([b[0] for b in blocks], pa.binary()), pa.array([b[1] for b in blocks], pa.binary())], schema=schema)

    return run


def _prefix_keys(rows: np.ndarray) -> list[np.ndarray]:
    """Keys of the first word, the first two and so on, as `_runs` makes them."""
    keys = [rows[:, 0]]
    for d in range(1, rows.shape[1]):
        keys.append(_pair_keys(keys[-1], rows[:, d]))
    return keys


def _subtrees(least: int, least_words: int, depth: int):
    """Counts of the nodes of a group's subtrees, from the totals of the leaves below them.

    Nodes above the prefix that chose the group go on in other groups: these keep any count.
    """
    schema = pa.schema([("phrase", pa.binary()), ("a", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        blocks = group["counts"].to_pylist()
        counts = np.frombuffer(b"".join(blocks), "<i8")
        fixed = np.repeat(group["prefix_words"].to_numpy(), [len(b) // 8 for b in blocks])
        rows = unpacked(group["suffixes"].to_pylist(), depth)
        order = np.lexsort(rows.T[::-1])
        rows, counts, fixed = rows[order], counts[order], fixed[order]
        lengths = (rows != 0).sum(axis=1)
        phrases, totals = [], []
        new = np.ones(len(rows), bool)
        new[1:] = rows[1:, 0] != rows[:-1, 0]
        for d in range(2, depth + 1):
            new[1:] |= rows[1:, d - 1] != rows[:-1, d - 1]
            if d < least_words:
                continue
            first = np.flatnonzero(new)
            total = np.add.reduceat(counts, first)
            # Rows that end above this depth are filled up with 0 and are no node of it.
            node = (lengths[first] >= d) & ((total >= least) | (fixed[first] > d))
            phrases.append(packed(rows[first[node], :d]))
            totals.append(total[node])
        return pa.Table.from_arrays([pa.concat_arrays(phrases), pa.array(np.concatenate(totals).astype(np.int64))], schema=schema)

    return run


def _first(phrase: Column | str, words: Column | int) -> Column:
    return F.substring(phrase, F.lit(1), F.lit(8) * words)


def phrase_counts(documents: DataFrame, least: int = 100, group_suffixes: int = GROUP_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """(lang, word, f, code, part) of all words, and (phrase, a) of all phrases of 2 to DEPTH words found
    `least` times or more, as the codes of their words."""
    docs = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    seed = 0
    while True:
        counted = docs.mapInArrow(_words(seed), "lang string, word string, code long, part binary, f long")
        words = written(counted.groupBy("lang", "word").agg(F.sum("f").alias("f"), F.first("code").alias("code"), F.first("part").alias("part")))
        shared = words.groupBy("code").count().where("count > 1 OR code = 0")
        if not shared.take(1):
            break
        seed += 1
    frequent = Bitmap(words.where(F.col("f") >= least), "code")
    pairs = written(docs.mapInArrow(_pairs(seed, frequent), "pair long, f long").groupBy("pair").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    most = max(1, group_suffixes // PREFIX_SHARE)
    longer = [Bitmap(pairs, "pair")]
    heavy = [Bitmap(words.where(F.col("f") > most), "code"), Bitmap(pairs.where(F.col("f") > most), "pair")]

    def counted(suffixes: int, least_words: int, depth: int) -> DataFrame:
        groups = max(1, -(-suffixes // group_suffixes))
        blocks = docs.mapInArrow(_suffixes(seed, frequent, longer, heavy, groups, least_words, depth),
                                 "group int, prefix_words int, suffixes binary, counts binary")
        nodes = blocks.repartition(groups, "group").groupBy("group").applyInArrow(_subtrees(least, least_words, depth), "phrase binary, a long")
        return written(nodes.groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least))

    def total(counts: DataFrame) -> int:
        return counts.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]

    short = counted(total(pairs), 2, FIRST_DEPTH)
    triples = written(short.where(F.length("phrase") == 8 * FIRST_DEPTH).mapInArrow(_keys, "key long, f long"))
    longer.append(Bitmap(triples, "key"))
    heavy.append(Bitmap(triples.where(F.col("f") > most), "key"))
    return words, short.unionByName(counted(total(triples), FIRST_DEPTH + 1, DEPTH))


def collocations(documents: DataFrame, least: int = 100, most: int = 2000, percent: int = 100,
                 group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """The best-scored phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are cut at `.,;:!?` and line ends into pieces, pieces at spaces and tabs into words;
    A-Z is lower-cased. Candidates are phrases of 2 to 5 words found at least `least` times. A
    phrase scores `1000 * a * n / (l * r)`, rounded down, at the cut where that is lowest, with
    the counts l and r of its two parts and n of all words of the language; of equal cuts the
    first counts. Candidates inside a longer one that is found `percent` per cent as often are
    dropped. Ranked by score, count (both falling) and phrase; the first `most` are returned.

    Rows without lang belong to `und`. Null, empty and blank texts have no words. Repeated rows
    count as often as they stand there. An empty table, or one without frequent phrases, gives no
    rows. Other columns are ignored.
    """
    words, phrases = phrase_counts(documents, least, group_suffixes)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = words.where(F.col("f") >= least).select("part", "f", "lang", "word")
    n_words = F.length("phrase") / 8
    counts = known.select("part", "f", "lang").unionByName(phrases.select(F.col("phrase").alias("part"), F.col("a").alias("f"), F.lit(None).cast("string").alias("lang")))

    cuts = phrases.select("phrase", "a", F.explode(F.sequence(F.lit(1), (n_words - 1).cast("int"))).alias("k")).select(
        "phrase", "a", "k", _first("phrase", F.col("k")).alias("left"),
        F.substring("phrase", F.col("k") * 8 + 1, F.length("phrase")).alias("right"))
    cuts = cuts.join(counts.select(F.col("part").alias("left"), F.col("f").alias("l"), "lang"), "left").join(
        counts.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
    by_phrase = cuts.groupBy("phrase", "a").agg(
        F.max("lang").alias("lang"), F.collect_list(F.struct("k", "l", "r")).alias("cuts"))  # at most DEPTH - 1
    wide = "CAST(1000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(n AS DECIMAL(38,0)) DIV (CAST(c.l AS DECIMAL(38,0)) * CAST(c.r AS DECIMAL(38,0)))"
    scored = by_phrase.join(totals, "lang").withColumn(
        "best", F.expr(f"array_min(transform(cuts, c -> struct({wide} AS score, c.k AS k, c.l AS l, c.r AS r)))")).select(
        "lang", "phrase", "a", "best.l", "best.r", "n", "best.score")

    inner = phrases.where(F.length("phrase") > 16).select("a", F.explode(F.expr("""flatten(transform(sequence(2, CAST(length(phrase) / 8 AS INT) - 1), m ->
        transform(sequence(0, CAST(length(phrase) / 8 AS INT) - m), i -> substring(phrase, 8 * i + 1, 8 * m))))""")).alias("phrase"))
    around = inner.groupBy("phrase").agg(F.max("a").alias("longer"))
    left = scored.join(around, "phrase", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")

    # Texts are only looked up for what can be among the first; equal scores and counts all stay.
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = written(left.withColumn("place", F.rank().over(order)).where(F.col("place") <= most).drop("place"))
    spelt = first.select("phrase", F.posexplode(F.expr(
        "transform(sequence(0, CAST(length(phrase) / 8 AS INT) - 1), i -> substring(phrase, 8 * i + 1, 8))")).alias("at", "part")).join(
        known.select("part", "word"), "part").groupBy("phrase").agg(F.collect_list(F.struct("at", "word")).alias("spelt"))  # at most DEPTH
    texts = spelt.select("phrase", F.array_join(F.transform(F.array_sort("spelt"), lambda s: s["word"]), " ").alias("text"))
    named = first.join(texts, "phrase").drop("phrase").withColumnRenamed("text", "phrase")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= most).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n",
                                                      F.col("score").cast("bigint").alias("score"))
