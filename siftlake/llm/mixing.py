"""Mix sources to target weights with hash thresholds. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import stored, word_count

#: The hash of a document has LEVELS digits of DIGIT_BITS bits; one histogram fixes one digit.
LEVELS = 6
DIGIT_BITS = 10
#: Digits of the id's hash; the others are of the text and tell apart rows that share an id or have none.
ID_LEVELS = 4
BUCKETS = 1 << DIGIT_BITS
#: Per-source rows hold a 64-bit key and a few numbers; up to so many (8 MB) they are broadcast.
BROADCAST_SOURCES = 100_000
SALTS = 32


def document_hash(doc_id: Column, text: Column) -> Column:
    """40 bits of the MD5 of the id as text (a null id counts as empty), then 20 bits of the text's hash."""
    hex_digits = ID_LEVELS * DIGIT_BITS // 4
    of_id = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, hex_digits), 16, 10).cast("bigint")
    rest = (LEVELS - ID_LEVELS) * DIGIT_BITS
    return F.shiftleft(of_id, rest) + F.xxhash64(text).bitwiseAND(F.lit((1 << rest) - 1))


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Targets of `sizes` (source, source_size): one row a source.

    Sources in code-point order, null last, take the weights in turn. A target is the least of
    `most` times the source's size and a level times its weight; resharing what is above the
    limit until none is above ends at the one level at which the targets add up. Along the
    sources by limit per weight, the level of each prefix of limited sources is one division,
    and the first that keeps the next source within its limit holds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    ordered = Window.orderBy("ratio", "rank")
    ranked = rows.withColumn("ratio", F.col("limit") / F.col("weight")).withColumn("rank", F.row_number().over(by_name))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    found = levels.withColumn("held", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything))
    target = F.when(F.col("held").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("held.level") * F.col("weight")))
    return found.select("source", "source_size", "weight", target.alias("target"))


def _with_source(docs: DataFrame, per_source: DataFrame, columns: list[str], few: bool) -> DataFrame:
    """Give every document its source's numbers: broadcast where the row count proves the size,
    else spread each source over SALTS parts."""
    side = per_source.select("key", *columns)
    if few:
        return docs.join(F.broadcast(side), "key")
    salted = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("salt", F.pmod(F.col("hash"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def _digit(level: int) -> Column:
    return F.shiftright("hash", (LEVELS - 1 - level) * DIGIT_BITS).bitwiseAND(F.lit(BUCKETS - 1))


def _keyed(documents: DataFrame) -> DataFrame:
    """The rows as one column, with the numbers that decide them beside it."""
    source = F.col("source").cast("string")
    return documents.select(
        F.struct("*").alias("row"), source.alias("source"), document_hash(F.col("doc_id"), F.col("text").cast("string")).alias("hash"),
        F.xxhash64(source.isNull(), source).alias("key"))


def mix_thresholds(sizes_of: DataFrame, weights: tuple[float, ...], share: float, most: float, broadcast_sources: int):
    """Per source: key, source_size, target, copies of all documents and the hash threshold of the
    rest; and whether these rows may be broadcast. `sizes_of` has key, source, hash and size."""
    sizes = sizes_of.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    copies = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("bigint")
    targets = stored(source_targets(sizes, list(weights), share, most).select(
        F.xxhash64(F.col("source").isNull(), "source").alias("key"), "source_size", "target", copies.alias("copies"),
        (F.col("target") - copies * F.col("source_size")).alias("rest")))
    few = targets.count() <= broadcast_sources
    state = targets.select("key", "rest", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("below"))
    for level in range(LEVELS):
        left = (LEVELS - level) * DIGIT_BITS
        inside = _with_source(sizes_of.select("key", "hash", "size"), state, ["prefix"], few).where(
            F.shiftright("hash", left) == F.col("prefix"))
        counts = inside.groupBy("key", _digit(level).alias("digit")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("key").orderBy("digit"))
        reached = counts.withColumn("running", running).join(state, "key").withColumn("upto", F.col("below") + F.col("running"))
        boundary = reached.groupBy("key").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.struct("digit", "upto", "words"))).alias("at"))
        # Without words the rest is 0 and nothing passes it: any threshold takes as much.
        state = stored(state.join(boundary, "key", "left").select(
            "key", "rest",
            (F.col("prefix") * BUCKETS + F.coalesce(F.col("at.digit"), F.lit(0))).alias("prefix"),
            F.coalesce(F.col("at.upto") - F.col("at.words"), F.col("below")).alias("below"),
            F.coalesce(F.col("at.words"), F.lit(0)).alias("edge")))
    closer = F.col("below") + F.col("edge") - F.col("rest") < F.col("rest") - F.col("below")
    threshold = state.select("key", (F.col("prefix") + closer.cast("bigint")).alias("threshold"))
    return targets.join(threshold, "key"), few


def _plan(documents: DataFrame, weights, share, most, broadcast_sources):
    sizes_of = stored(_keyed(documents).select(
        "key", "source", "hash", F.col("row.doc_id").alias("doc_id"),
        word_count(F.col("row.text").cast("string")).alias("size")))
    return sizes_of, *mix_thresholds(sizes_of, weights, share, most, broadcast_sources)


def _copies() -> Column:
    return F.col("copies") + (F.col("hash") < F.col("threshold")).cast("bigint")


def mix_sources(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """How many words the mix takes from each document.

    Returns doc_id, size, source_size, target, taken. A source's target gives whole copies of all
    its documents and a rest; the rest goes to the documents whose hash is below a threshold. The
    threshold is found digit by digit: words by source and first hash digit, the bucket in which
    the running sum passes the rest, then only that bucket by the next digit. Thresholds of larger
    rests lie higher, so a larger share keeps what a smaller one took. Nothing is sorted: a level
    is one partial aggregate and a running sum over at most 1024 buckets a source.

    Nulls: a null text has size 0, a null source is a source, a null id hashes as empty. Rows of a
    source that share a doc_id, or have none, are told apart by their texts; those with one text
    as well share a hash and are taken together. The last such group is taken if that comes
    closer to the target. An empty table gives no rows.
    """
    sizes_of, per_source, few = _plan(documents, weights, share, most, broadcast_sources)
    out = _with_source(sizes_of, per_source, ["source_size", "target", "copies", "threshold"], few)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mixed_documents(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                    broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns. The
    same thresholds as in `mix_sources`, and the same results for nulls, ties, repeated rows and
    empty tables; texts are not shuffled."""
    _, per_source, few = _plan(documents, weights, share, most, broadcast_sources)
    out = _with_source(_keyed(documents).drop("source"), per_source, ["copies", "threshold"], few)
    return out.select("row", _copies().alias("n")).where("n > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select("row.*")
