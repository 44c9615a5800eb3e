"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A document's signature is 32 MinHash symbols of 16 bits. Two signatures that differ in at most 15
symbols have, among their 8 chunks of 4 symbols, one with at most one difference (pigeonhole).
Each chunk is therefore indexed four times, each time with another symbol left out: signatures
that agree in the other three symbols meet in a bucket, so every pair within distance 15 does.
At a similarity of 0.8 the distance has mean 6.4 and a pair fails to meet with probability 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import WordHashes, byte_texts, shingle_set, written

SYMBOLS = 32
CHUNK = 4
#: Ids of documents (8 bytes) that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Members of a centre that are compared with all others first.
SOME = 64
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 8192


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the least hash of the set under each of the seeds; sets of any size in blocks."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), _BLOCK):
        h = shingles[start:start + _BLOCK, None] * _SEEDS
        h ^= h >> np.uint64(33)
        np.minimum(least, h.min(axis=0), out=least)
    return (least & np.uint64(0xFFFF)).astype(np.int32)


def _sketch(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, digests, signatures = [], [], []
            for text in byte_texts(batch.column("text")):
                found = shingle_set(hashes.of(text.lower().split()), k)
                counts.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                                              pa.array(signatures, pa.list_(pa.int32()))], schema=schema)

    return run


def _sets(k: int):
    schema = pa.schema([("class", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                found = [shingle_set(hashes.of(t.lower().split()), k).view(np.int64) for t in byte_texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return run


def bucket_keys(signature: Column) -> Column:
    """A key for each chunk and each symbol left out of it."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(SYMBOLS - 1)),
        lambda i: F.xxhash64(i, F.filter(F.slice(signature, i - i % CHUNK + 1, CHUNK), lambda s, j: j != i % CHUNK)))


def _roots(hooks: DataFrame) -> DataFrame:
    """Follows `hooks` (node, up) to the end, twice as far with each step: node, up."""
    while True:
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = written(hooks.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        hooks = jumped.select("node", "up")
        if not jumped.where("moved").take(1):
            return hooks


def components(links: DataFrame) -> DataFrame:
    """Label each node of `links` (a, b) with the smallest node it can reach: node, label.

    Each round hooks every node to its lowest neighbour, if that is lower than itself, follows
    the hooks to their ends and replaces nodes by these, until no link between different nodes
    is left. Odd rounds take the lower id, which ends stars and chains in id order at once; even
    rounds a hash drawn anew, by which at least half of the nodes of any graph are expected to
    hook. Tables stay distributed and are written each round; the driver sees one row.
    No links give no labels.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node")))
    turn = 0
    while edges.take(1):
        turn += 1
        height = [F.col(c) if turn % 2 else F.xxhash64(c, F.lit(turn)) for c in ("a", "b")]
        lowest = edges.groupBy("a").agg(F.min(F.struct(height[1].alias("height"), F.col("b").alias("node"))).alias("low"))
        roots = _roots(written(lowest.select(F.col("a").alias("node"), F.when(F.col("low.height") < height[0], F.col("low.node")).otherwise(F.col("a")).alias("up"))))
        labels = written(labels.join(roots.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        ends = [roots.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in ("a", "b")]
        edges = written(edges.join(ends[0], "a").join(ends[1], "b").where("up_a <> up_b").select(
            F.col("up_a").alias("a"), F.col("up_b").alias("b")).distinct())
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return written(labels.join(least, "label").select("node", F.col("least").alias("label")))


def _pairs(left: Column | str, right: Column | str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _with_sets(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        pairs = pairs.join(sets.select(F.col("class").alias(c), F.col("shingles").alias(f"set_{c}")), c)
    return pairs


def _similar(n: Column, m: Column, common: Column, percent: int) -> Column:
    return common * 100 >= (n + m - common) * percent


def _least_common(n: Column, m: Column, percent: int) -> Column:
    """How many shingles sets of n and m must share to have `percent` in common."""
    return F.ceil((n + m) * percent / (100 + percent))


def _mixed(members: DataFrame) -> DataFrame:
    """Members of centres that have members with different labels."""
    both = members.groupBy("centre").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("centre")
    return members.join(both, "centre")


def _best_of_others(members: DataFrame, column: str) -> DataFrame:
    """Adds the largest value of a column among the members of the centre with another label."""
    by_label = members.groupBy("centre", "label").agg(F.max(column).alias("best"))
    top = by_label.groupBy("centre").agg(F.max(F.struct("best", "label")).alias("top"))
    second = by_label.join(top, "centre").groupBy("centre", "top").agg(F.max(F.when(F.col("label") != F.col("top.label"), F.col("best"))).alias("second"))
    other = F.when(F.col("label") == F.col("top.label"), F.col("second")).otherwise(F.col("top.best"))
    return members.join(second, "centre").withColumn(f"{column}_other", other).drop("top", "second")


def _prune(sized: DataFrame, percent: int) -> DataFrame:
    """Members that may be similar to a member with another label, as far as `inner` and `outer` say."""
    offered = _best_of_others(_best_of_others(sized, "inner"), "outer").join(sized.groupBy("centre").agg(F.min("n").alias("least")), "centre")
    smallest = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    most = F.least("inner", "inner_other") + F.least("outer", "outer_other")
    able = offered.where(most >= _least_common(F.col("n"), smallest, percent))
    return written(_mixed(able.select("centre", "class", "label", "n", "inner", "outer")))


def _able(members: DataFrame, percent: int) -> DataFrame:
    """Members of one centre (centre, class, label, n, inner, extra) that may be similar to one
    with another label. `inner` is how many shingles a member shares with the centre, `extra` are
    its other ones.

    Two members share at most the smaller of their `inner` and, outside the centre, the smaller
    of their `outer`: how many of their extra shingles a member with another label has as well.
    Documents that have a passage in common, or copies that have drifted too far, are so told
    apart by two numbers and not held against each other.
    """
    rest = written(_mixed(members))
    extras = rest.select("centre", "class", "label", F.explode("extra").alias("shingle"))
    shared = extras.groupBy("centre", "shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("centre", "shingle")
    outer = extras.join(shared, ["centre", "shingle"]).groupBy("centre", "class").agg(F.count("*").cast("int").alias("outer"))
    return _prune(written(rest.drop("extra").join(outer, ["centre", "class"], "left").fillna(0, ["outer"])), percent)


def _able_pairs(left: DataFrame | None, right: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one centre with different labels that the numbers leave possible; all
    pairs of `right` where there is no `left`."""
    one, two = (rows.select("centre", *[F.col(c).alias(f"{c}{side}") for c in ("class", "label", "n", "inner", "outer")])
                for side, rows in ((1, right if left is None else left), (2, right)))
    common = F.least("inner1", "inner2") + F.least("outer1", "outer2")
    apart = F.col("label1") < F.col("label2") if left is None else F.col("label1") != F.col("label2")
    possible = apart & (common >= _least_common(F.col("n1"), F.col("n2"), percent))
    return one.join(two, "centre").where(possible).select(*_pairs("class1", "class2")).distinct()


def _some(members: DataFrame) -> DataFrame:
    """At most SOME members of each centre, chosen by their hash."""
    order = Window.partitionBy("centre").orderBy(F.xxhash64("class"), "class")
    return members.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= SOME).drop("turn")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: a link between members is one between their labels."""
    for c in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}")), c, "left")
    ends = links.select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b")).where("a <> b")
    upper = components(ends)
    everything = labels.unionByName(upper.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
    return written(everything.join(upper.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select(
        "node", F.coalesce("top", "label").alias("label")))


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("node").alias("class"), "label")
    return members.drop("label").join(known, "class", "left").withColumn("label", F.coalesce("label", "class"))


def class_links(documents: DataFrame, sketch: DataFrame, k: int, percent: int, row_limit: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Components of the classes of equal sets: (digest, class) and (node, label).

    Every bucket is first compared with its centre, the member that shares most buckets with
    others, which joins a family of copies by as many pairs as it has members. Members of buckets
    with the same centre that still have different labels are compared pair by pair where they
    can be similar, so every pair that meets in a bucket is confirmed or refuted, or already
    linked by others.
    """
    rows = sketch.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    groups = written(rows.groupBy("digest").agg(F.min("doc_id").alias("class"), F.first("signature").alias("signature")))
    # Rows that share a doc_id are one document, whatever their texts.
    named = rows.select("doc_id", "digest").join(groups.select("digest", "class"), "digest").select("doc_id", "class").distinct()
    several = named.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("doc_id", "a")
    same_id = named.join(several, "doc_id").where("class <> a").select("a", F.col("class").alias("b"))
    keyed = groups.select("class", F.explode(bucket_keys(F.col("signature"))).alias("key")).distinct()
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    live = written(keyed.join(sizes, "key"))
    weight = written(live.groupBy("class").agg(F.sum("size").alias("weight")))
    wanted = weight.select(F.col("class").alias("doc_id"))
    texts = documents.join(F.broadcast(wanted) if wanted.count() <= row_limit else wanted, "doc_id", "left_semi")
    sets = written(texts.mapInArrow(_sets(k), "class long, shingles array<long>"))

    ranked = live.select("key", "class").join(weight, "class")
    centre = ranked.groupBy("key").agg(F.max(F.struct("weight", "class")).alias("best")).select("key", F.col("best.class").alias("centre"))
    placed = live.select("key", "class").join(centre, "key").where("class <> centre").select("class", "centre").distinct()
    compared = written(_with_sets(placed, sets, "class", "centre").select(
        "class", "centre", F.size("set_class").alias("n"), F.size("set_centre").alias("n_centre"),
        F.size(F.array_intersect("set_class", "set_centre")).alias("inner"), F.array_except("set_class", "set_centre").alias("extra")))
    first = compared.where(_similar(F.col("n"), F.col("n_centre"), F.col("inner"), percent)).select(*_pairs("class", "centre"))
    links = written(first.union(same_id).distinct())
    labels = components(links)
    able = _able(_named(compared.drop("n_centre"), labels), percent)
    done = compared.select(*_pairs("class", "centre"))
    # First a few members against all with other labels: links join families, and what has one
    # label needs no pairs. Then all that still have different labels.
    for left in (_some(able), None):
        candidates = _able_pairs(left, able, percent).join(done, ["a", "b"], "left_anti")
        pairs = _with_sets(candidates, sets, "a", "b")
        common = F.size(F.array_intersect("set_a", "set_b"))
        more = written(pairs.where(_similar(F.size("set_a"), F.size("set_b"), common, percent)).select("a", "b").distinct())
        if more.take(1):
            labels = _merged(labels, more)
            able = _prune(written(_named(able, labels)), percent) if left is not None else able
    return groups.select("digest", "class"), labels


def near_duplicates(documents: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of k-word shingles have `percent` in common or more.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id is
    component_id). Words are lower-cased in A-Z; a text of fewer than k words is one shingle.
    Texts without words and null texts are linked with nothing. Rows that share a doc_id are one
    document; rows without doc_id are linked with nothing, have no component and are kept. An
    empty table gives no rows. Equal sets are one class, so copies cost nothing beyond their row.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = written(docs.mapInArrow(_sketch(k), "doc_id long, n_shingles long, digest binary, signature array<int>"))
    members, labels = class_links(docs, sketch, k, percent)
    named = members.join(labels.select(F.col("node").alias("class"), "label"), "class", "left").select(
        "digest", F.coalesce("label", "class").alias("label"))
    columns = sketch.select("doc_id", "n_shingles", "digest")
    found = columns.where("digest IS NOT NULL").join(named, "digest", "left").select("doc_id", "n_shingles", "label").union(
        columns.where("digest IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("bigint")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_documents(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: the one with the
    smallest doc_id. Of rows that repeat a doc_id and its text one stays. Null, empty and blank
    texts are in no group: they stay, as do all rows without doc_id. An empty table stays empty."""
    kept = near_duplicates(documents, k, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept_id")).distinct()
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    first = Window.partitionBy("_id", "_text").orderBy("_id")
    named = rows.where("_id IS NOT NULL").join(kept, F.col("_id") == F.col("_kept_id"), "left_semi").withColumn(
        "_copy", F.row_number().over(first)).where("_copy = 1")
    return named.select("row").union(rows.where("_id IS NULL").select("row")).select("row.*")
