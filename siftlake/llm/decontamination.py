"""Find benchmark items in documents. DataFrame and SQL functions only.

An item is looked for in windows of its own size. A window that shares no shingle with any item
has similarity 0 to all of them, so windows start where a shingle of some item of that size
stands. Windows and items get a 64-bit SimHash; fingerprints within the radius agree, up to
radius // blocks bits, in one of the blocks (pigeonhole), so an index of the items by block, block
value and size, with these few errors enumerated, yields all of them. Candidates within the radius
are verified by their exact weighted similarity. Windows of long items are not written out: what
each shares with the item is summed from where its shingles come in and go out.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import stored

#: Lower-cased words are runs of digits, letters a to z and everything beyond ASCII.
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: At similarity 0.8 two fingerprints differ by 9.7 bits on average; more than 25 has probability 1e-6.
RADIUS = 25
BLOCKS = 13
#: Longer items are compared as a whole without a fingerprint, and reported in parts of this size.
MAX_WINDOW = 8192
#: Item tables with at most so many rows are broadcast; a row is a few numbers.
BROADCAST_ROWS = 1_000_000
#: Words of all items up to which their shingle lists (8 bytes a word) are broadcast as well.
BROADCAST_WORDS = 4_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NO_WORD), "")


def shingles(words: str, k: int) -> Column:
    """Hash of every run of k words; none if there are fewer."""
    parts = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return F.expr(f"CASE WHEN size({words}) >= {k} THEN transform(sequence(0, size({words}) - {k}), i -> xxhash64({parts})) "
                  f"ELSE cast(array() AS array<bigint>) END")


def simhash(grams: str) -> Column:
    """SimHash of a list of 64-bit hashes, each occurrence with weight 1.

    Bit s of 16-bit lanes 0 to 3 are counted together in one long, so a hash is added with 16
    additions; a bit of the fingerprint is set if more than half of the hashes have it.
    """
    counts = (f"aggregate({grams}, array_repeat(0L, 16), (acc, h) -> transform(acc, "
              f"(a, s) -> a + (shiftrightunsigned(h, s) & 281479271743489L)))")  # bits 0, 16, 32 and 48
    return F.expr(f"aggregate(sequence(0, 63), named_struct('c', {counts}, 'f', 0L), (acc, j) -> named_struct('c', acc.c, 'f', acc.f | "
                  f"CASE WHEN 2 * (shiftrightunsigned(acc.c[j % 16], 16 * (j div 16)) & 65535L) > size({grams}) "
                  f"THEN shiftleft(1L, j) ELSE 0L END), acc -> acc.f)")


def block_layout(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """Shift and width of each block of the 64 bits; widths differ by one at most."""
    widths = [64 // blocks + (b < 64 % blocks) for b in range(blocks)]
    return [(sum(widths[:b]), width) for b, width in enumerate(widths)]


def _errors(width: int, most: int) -> list[int]:
    return [sum(1 << bit for bit in bits) for n in range(most + 1) for bits in combinations(range(width), n)]


def _blocks(fingerprint: str, errors: int, blocks: int) -> Column:
    """(block, value) of a fingerprint, with each value up to `errors` bits away."""
    entries = [f"named_struct('block', {b}, 'value', (shiftrightunsigned({fingerprint}, {shift}) & {(1 << width) - 1}L) ^ {mask}L)"
               for b, (shift, width) in enumerate(block_layout(blocks)) for mask in _errors(width, errors)]
    return F.expr(f"inline(array({', '.join(entries)}))")


def _first_block(left: str, right: str, errors: int, blocks: int) -> Column:
    """The first block in which two fingerprints agree up to `errors` bits."""
    tests = " ".join(f"WHEN bit_count(shiftrightunsigned({left} ^ {right}, {shift}) & {(1 << width) - 1}L) <= {errors} THEN {b}"
                     for b, (shift, width) in enumerate(block_layout(blocks)))
    return F.expr(f"CASE {tests} ELSE -1 END")


def _common(left: str, right: str) -> Column:
    """Weight of what two shingle lists share, each occurrence counted once."""
    plain = f"size(array_intersect({left}, {right}))"
    return F.expr(f"CASE WHEN size(array_distinct({left})) = size({left}) OR size(array_distinct({right})) = size({right}) THEN {plain} "
                  f"ELSE aggregate(array_distinct({right}), 0, (acc, x) -> acc + least(size(filter({left}, y -> y = x)), "
                  f"size(filter({right}, y -> y = x)))) END")


def benchmark_items(benchmark: DataFrame, k: int) -> DataFrame:
    """Items as they are looked for: item_id, length in words, gram size, grams, fingerprint (if not long).
    Items without words cannot be found and are left out."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    sized = words.withColumn("length", F.size("words")).withColumn("gram", F.least(F.lit(k), F.col("length")))
    grams = F.coalesce(*[F.when(F.col("gram") == g, shingles("words", g)) for g in range(1, k + 1)])
    return sized.withColumn("grams", grams).withColumn("fingerprint", F.when(F.col("length") <= MAX_WINDOW, simhash("grams"))).select(
        "item_id", "length", "gram", "grams", "fingerprint", F.xxhash64("length", "grams").alias("item"))


def anchors(documents: DataFrame, items: DataFrame, row_limit: int = BROADCAST_ROWS) -> DataFrame:
    """Where shingles of items stand: doc_id, text_key, and for each document its (gram, length, at).

    The place is exploded and the hash made from it in one projection that drops the words, so a
    row of a place holds two numbers beside the key and never the text.
    """
    starts = stored(items.select("gram", "length", F.explode("grams").alias("hash")).distinct())
    few = starts.count() <= row_limit
    texts = documents.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"), words_of(F.col("text")).alias("words"))
    out = None
    for row in starts.select("gram").distinct().sort("gram").collect():  # at most k sizes
        gram = row["gram"]
        wanted = starts.where(F.col("gram") == gram).select("hash", "length", "gram")
        last = F.size("words") - gram
        placed = texts.where(last >= 0).select("doc_id", "text_key", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        hashed = placed.select("doc_id", "text_key", "at", F.xxhash64(*[F.col("words")[F.col("at") + j] for j in range(gram)]).alias("hash"))
        found = hashed.join(F.broadcast(wanted) if few else wanted, "hash").select("doc_id", "text_key", "gram", "length", "at")
        out = found if out is None else out.union(found)
    if out is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, text_key long, places array<struct<gram:int,length:int,at:int>>")
    return stored(out.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("gram", "length", "at")).alias("places")))


def item_windows(documents: DataFrame, items: DataFrame, k: int, row_limit: int = BROADCAST_ROWS) -> DataFrame:
    """Windows of documents that start at a shingle of an item of the window's size: doc_id,
    text_key, length, start and the window's shingles.

    The best window for an item may be taken to start at a shared shingle: moving its start to the
    first one it holds loses none, and near the end of a text it stops at the last full window. A
    text shorter than the item is one window. Only documents with such places are read again.
    """
    found = anchors(documents, items, row_limit)
    places = found.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    side = found.select(F.col("doc_id").alias("place_id"), F.col("text_key").alias("place_key"), "places")
    side = F.broadcast(side) if places <= row_limit else side
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    held = texts.join(side, (F.col("text_key") == F.col("place_key")) & F.col("doc_id").eqNullSafe(F.col("place_id"))).select(
        "doc_id", "text_key", words_of(F.col("text")).alias("words"), "places")
    cut = held.select("doc_id", "text_key", F.expr("""
        transform(array_distinct(transform(places, p -> named_struct('gram', p.gram, 'length', p.length,
            'start', greatest(0, least(p.at, size(words) - p.length))))),
          p -> named_struct('gram', p.gram, 'length', p.length, 'start', p.start, 'window', slice(words, p.start + 1, p.length)))
        """).alias("windows")).select("doc_id", "text_key", F.inline("windows"))
    grams = F.coalesce(*[F.when(F.col("gram") == g, shingles("window", g)) for g in range(1, k + 1)])
    return cut.select("doc_id", "text_key", "length", "start", grams.alias("grams"))


def long_hits(documents: DataFrame, items: DataFrame, k: int, percent: int, row_limit: int = BROADCAST_ROWS) -> DataFrame:
    """Best window of each document and long item: doc_id, text_key, item_id, length, similarity, start, n_words.

    Of the places of a shingle that an item holds m times, one counts in a window if it is in it
    and the m-th place before it is not. So it counts for one run of starts, and a running sum over
    where these runs begin and end gives the common weight of every window. Rows are as many as
    places of shingles of the item in the document, not windows times their length.
    """
    grams = stored(items.select("item", "length", F.size("grams").alias("item_size"), F.explode("grams").alias("hash")).groupBy(
        "item", "length", "item_size", "hash").agg(F.count("*").cast("int").alias("times")))
    wanted = F.broadcast(grams) if grams.count() <= row_limit else grams
    texts = documents.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"), words_of(F.col("text")).alias("words")).where(
        F.size("words") >= k)
    placed = texts.select("doc_id", "text_key", "words", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("at"))
    hashed = placed.select("doc_id", "text_key", "at", F.size("words").alias("n"), F.xxhash64(*[F.col("words")[F.col("at") + j] for j in range(k)]).alias("hash"))
    pair = ["doc_id", "text_key", "item", "n", "length", "item_size"]
    places = hashed.join(wanted, "hash").groupBy(*pair, "hash", "times").agg(F.sort_array(F.collect_set("at")).alias("places"))
    each = places.select(*pair, "times", "places", F.posexplode("places").alias("i", "at"))
    last = F.greatest(F.lit(0), F.col("n") - F.col("length"))
    size = F.least(F.col("n"), F.col("length")) - (k - 1)
    before = F.when(F.col("i") >= F.col("times"), F.expr("places[i - times]")).otherwise(-1)
    runs = each.withColumn("last", last).withColumn("first", F.greatest(F.lit(0), F.col("at") - size + 1, before + 1)).withColumn(
        "start", F.least("at", "last"))
    # A place is where a window may start, and where a run may begin or end behind it.
    events = runs.select(*pair, F.expr("""inline(array(named_struct('at', start, 'change', 0, 'window', true),
        named_struct('at', first, 'change', if(first <= start, 1, 0), 'window', false),
        named_struct('at', start + 1, 'change', if(first <= start, -1, 0), 'window', false)))"""))
    sums = events.groupBy(*pair, "at").agg(F.sum("change").alias("change"), F.max("window").alias("window"))
    common = F.sum("change").over(Window.partitionBy(*pair).orderBy("at"))
    whole = size + F.col("item_size") - F.col("common")
    hits = sums.withColumn("common", common).where("window").where(F.col("common") * 100 >= whole * percent).withColumn("similarity", F.col("common") / whole)
    best = hits.groupBy(*pair).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("at").alias("start"))).alias("best"))
    named = best.join(items.select("item", "item_id"), "item")
    return named.select("doc_id", "text_key", "item_id", "length", (-F.col("best.s")).alias("similarity"), F.col("best.start").alias("start"),
                        F.least("n", "length").alias("n_words"))


def contaminated(documents: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, radius: int = RADIUS,
                 blocks: int = BLOCKS, row_limit: int = BROADCAST_ROWS) -> DataFrame:
    """Benchmark items that stand in a document: doc_id, text_key, item_id, part, similarity, start, n_words.

    One row for a document and item: the first word of the best window and its weighted similarity,
    the weight of common shingles over that of all, if it is `percent` or more. Part 0 is this
    window; an item over MAX_WINDOW words, compared as a whole like any other, has a row for each
    further MAX_WINDOW words as well, with the word where they start. An item of fewer than k words is one shingle of its own size. Null
    and empty texts and items hold nothing; a null doc_id or item_id stays null in the result; rows
    that repeat a document (doc_id and text) give one result. Empty tables give no rows.
    """
    errors = radius // blocks
    every = stored(benchmark_items(benchmark, k))
    items, long = every.where(F.col("length") <= MAX_WINDOW), every.where(F.col("length") > MAX_WINDOW)
    windows = stored(item_windows(documents, items, k, row_limit)).where("size(grams) > 0")
    windows = stored(windows.withColumn("mark", simhash("grams")))
    index = stored(items.select("item", "length", "gram", "fingerprint").distinct().select(
        "item", "length", "fingerprint", _blocks("fingerprint", errors, blocks)))
    sizes = index.agg(F.count("*").alias("n")).first()["n"], items.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    index = F.broadcast(index) if sizes[0] <= row_limit else index
    probes = windows.select("doc_id", "text_key", "length", "start", "grams", "mark", _blocks("mark", 0, blocks))
    near = probes.join(index, ["length", "block", "value"]).where(
        (F.col("block") == _first_block("mark", "fingerprint", errors, blocks)) & (F.expr("bit_count(mark ^ fingerprint)") <= radius))
    lists = items.select("item", "item_id", F.col("grams").alias("item_grams"))
    lists = F.broadcast(lists) if sizes[0] <= row_limit and sizes[1] <= BROADCAST_WORDS else lists
    # Compared once and stored: filters on the figures would otherwise compare again for each use.
    checked = stored(near.join(lists, "item").withColumn("common", _common("grams", "item_grams"))).withColumn(
        "all", F.size("grams") + F.size("item_grams") - F.col("common"))
    hits = checked.where(F.col("common") * 100 >= F.col("all") * percent).withColumn("similarity", F.col("common") / F.col("all"))
    best = hits.groupBy("doc_id", "text_key", "item_id").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "start", (F.size("grams") + k - 1).alias("n_words"))).alias("best"))
    found = best.select("doc_id", "text_key", "item_id", F.lit(0).alias("part"), (-F.col("best.s")).alias("similarity"), "best.start", "best.n_words")
    if long.isEmpty():
        return found
    parts = F.posexplode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(MAX_WINDOW))).alias("part", "offset")
    whole = long_hits(documents, long, k, percent, row_limit).groupBy("doc_id", "text_key", "item_id").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n_words", "length")).alias("best")).select("doc_id", "text_key", "item_id", "best.*")
    return found.unionByName(whole.select("doc_id", "text_key", "item_id", (-F.col("s")).alias("similarity"), "start", "n_words", "length").select(
        "*", parts).where(F.col("offset") < F.col("n_words")).select("doc_id", "text_key", "item_id", "part", "similarity", (F.col("start") + F.col("offset")).alias("start"), "n_words"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, row_limit: int = BROADCAST_ROWS, **settings) -> DataFrame:
    """The documents that hold no item, with all their columns. Null and empty texts hold nothing
    and stay, with or without doc_id; repeated rows go or stay together. Without items all stay,
    without documents none."""
    found = stored(contaminated(documents, benchmark, row_limit=row_limit, **settings).select(
        F.col("doc_id").alias("_found_id"), F.col("text_key").alias("_found_key")).distinct())
    side = F.broadcast(found) if found.count() <= row_limit else found
    same = documents["doc_id"].eqNullSafe(side["_found_id"]) & (F.xxhash64(documents["text"].cast("string")) == side["_found_key"])
    return documents.join(side, same, "left_anti")
