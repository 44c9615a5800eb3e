"""Token ids as flat binary files, and their way back.

A folder holds, for each shard: `part-N.bin`, the ids of its documents one after another as
little-endian unsigned integers; `part-N.idx`, one more 64-bit offset than documents, counted
in ids from the start of the shard; and `part-N.doc`, the 64-bit doc_ids. Null doc_ids sort
first; their number is in the manifest, a table with one row a shard. The place of a shard in
the whole sequence is the sum of the shards before it, so no file needs to know another.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.llm.common import shared_path

#: Entries of a word cache before it starts anew.
CACHE_ENTRIES = 1_000_000
#: Words that are encoded together.
BLOCK_WORDS = 100_000


# The settings of a tokenizer that lower-cases and cuts texts at white space, between
# letters and between punctuation and letters.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def encodes_by_words(path: str) -> bool:
    """Whether a text's ids are those of its words, one after another: the settings above, and no
    added token that holds or takes up white space."""
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    added = settings.get("added_tokens") or []
    plain = all(len(t["content"].split()) == 1 and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
    return plain and all(settings.get(key) == value for key, value in BY_WORDS.items())


class WordEncoder:
    """Ids of whole texts. A tokenizer whose pieces never cross white space gives a text the ids
    of its words, so each distinct word is encoded once, and a word that ends in punctuation after
    an ASCII letter as two pieces. Any other tokenizer encodes every text as it stands.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.by_words = encodes_by_words(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = dtype
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Encode words that are not in the cache; what is new in all of them in one call."""
        order, bodies, ends = list(words), [], []
        for text in map(bytes.decode, order):
            body = text.rstrip(".,;:!?")
            end = ""
            if body != text:
                if body and body[-1].isascii() and body[-1].isalpha():  # others may end in a mark once lower-cased
                    end = text[len(body):]
                else:
                    body = text
            if body.isascii():
                body = body.lower()
            bodies.append(body)
            ends.append(end)
        lacking = set(bodies).union(ends).difference(self.pieces)
        others = []
        for piece in lacking:
            if piece.isascii() and piece.isalpha():  # as the normalizer and splitter leave it
                self.pieces[piece] = np.array([t.id for t in self.model.tokenize(piece)], self.dtype).tobytes()
            else:
                others.append(piece)
        for piece, got in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            self.pieces[piece] = np.array(got.ids, self.dtype).tobytes()
        ids = self.pieces.__getitem__
        self.words.update(zip(order, map(bytes.__add__, map(ids, bodies), map(ids, ends))))

    def encode(self, lists: list[list[bytes]]) -> list[bytes]:
        """The ids of lists of words."""
        distinct = set(chain.from_iterable(lists))
        missing = distinct.difference(self.words)
        if missing:
            if len(self.words) + len(missing) > CACHE_ENTRIES:
                self.words.clear()
                missing = distinct
            if len(self.pieces) > CACHE_ENTRIES:
                self.pieces.clear()
            self.learn(missing)
        return [b"".join(map(self.words.__getitem__, words)) for words in lists]

    def encode_texts(self, texts: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
        """The ids of whole texts in turn, in pieces of bounded size, and whether the text ends
        with the piece. Several texts are encoded together, long ones in blocks of words."""
        if not self.by_words:
            for text in texts:
                yield np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype).tobytes(), True
            return
        lists, ends, held = [], [], 0
        for text in texts:
            words = text.split()
            for start in range(0, max(1, len(words)), BLOCK_WORDS):
                lists.append(words[start:start + BLOCK_WORDS])
                ends.append(start + BLOCK_WORDS >= len(words))
                held += len(lists[-1])
                if held >= BLOCK_WORDS:
                    yield from zip(self.encode(lists), ends)
                    lists, ends, held = [], [], 0
        yield from zip(self.encode(lists), ends)


_ENCODERS: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, dtype: str) -> WordEncoder:
    """One per Python worker, so that the caches serve all its tasks."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = WordEncoder(path, dtype)
    return _ENCODERS[path, dtype]


def _write_shard(folder: str, path: str, end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        store, root = pafs.FileSystem.from_uri(folder)
        names = {kind: f"{root}/part-{shard:06d}.{kind}" for kind in ("bin", "idx", "doc")}
        drafts = {kind: f"{root}/_attempt-{attempt}-{shard:06d}.{kind}" for kind in names}
        code, end = encoder(path, dtype), np.array([end_id], dtype).tobytes()
        width, at, nulls, docs = len(end), 0, 0, 0
        files = {kind: store.open_output_stream(name) for kind, name in drafts.items()}
        files["idx"].write(np.array([0], "<u8").tobytes())
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            offsets = []
            for part, ended in code.encode_texts(t.as_py() or b"" for t in texts.cast(pa.binary())):
                files["bin"].write(part + end if ended else part)
                at += len(part) // width + ended
                if ended:
                    offsets.append(at)
            files["idx"].write(np.array(offsets, "<u8").tobytes())
            files["doc"].write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            nulls += ids.null_count
            docs += len(ids)
        for kind, file in files.items():
            file.close()
            store.move(drafts[kind], names[kind])  # a repeated attempt writes the same bytes
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "docs": [docs], "nulls": [nulls], "tokens": [at]},
            pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("nulls", pa.int64()), ("tokens", pa.int64())]))

    return run


def write_token_files(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int, dtype: str = "<u2") -> None:
    """Encode every whole text (null: empty), end each document with `end_id`, and write shards
    in ascending doc_id order.

    Documents are range-partitioned, so shards follow each other and no task sees more than its
    range. Each attempt writes its own draft and moves it into place when complete; the manifest
    is committed by Spark and names the finished shards. Rows that repeat a doc_id (or have none,
    which come first) stand beside each other, in the order of their texts' hashes. An empty table gives an empty manifest or empty shards.
    """
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows without id, or with one that many share, are ranges of their texts' hashes.
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text").drop("text_hash")
    ordered.mapInArrow(_write_shard(folder, tokenizer_path, end_id, dtype),
                       "shard int, docs long, nulls long, tokens long").write.parquet(f"{folder}/manifest")


def token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row a shard with its place: `start` in ids, from the sums of the shards before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{folder}/manifest").withColumn(
        "start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("bigint"))


def _mapped(store: pafs.FileSystem, name: str, dtype: str) -> np.ndarray:
    if store.get_file_info(name).size == 0:
        return np.empty(0, dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(name, dtype, "r")
    with store.open_input_file(name) as file:
        return np.frombuffer(file.read_buffer(), dtype)


def _read_shards(folder: str, dtype: str, block: int = 4096):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for row in (r for batch in batches for r in batch.to_pylist()):
            ids, offsets, docs = (_mapped(store, f"{root}/part-{row['shard']:06d}.{kind}", kind_type)
                                  for kind, kind_type in (("bin", dtype), ("idx", "<u8"), ("doc", "<i8")))
            offsets = offsets.astype(np.int64)
            for first in range(0, row["docs"], block):
                last = min(first + block, row["docs"])
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[first:last], offsets[first + 1:last + 1])]
                missing = np.arange(first, last) < row["nulls"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs[first:last], pa.int64(), mask=missing),
                    pa.array(offsets[first:last] + row["start"]),
                    pa.array(np.diff(offsets[first:last + 1])),
                    pa.array(crcs, pa.int64())], schema=schema)

    return run


def read_token_files(spark: SparkSession, folder: str, dtype: str = "<u2") -> DataFrame:
    """Each document's place, length and checksum, from the mapped files; one task a shard."""
    shards = token_shards(spark, folder)
    spread = shards.repartition(max(1, spark.read.parquet(f"{folder}/manifest").count()), "shard")
    return spread.mapInArrow(_read_shards(folder, dtype), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(documents: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the files and read them back: doc_id, start, n_tokens (with the end id), ids_crc32.

    Null and empty texts hold the end id alone. Rows without doc_id come first, repeated rows
    each have their ids, and an empty table gives no rows. Other columns are not written.
    """
    from tokenizers import Tokenizer

    spark = documents.sparkSession
    folder = folder or shared_path(spark, "tokens")
    largest = max(end_id, *Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values())
    dtype = "<u2" if largest < 1 << 16 else "<u4"
    write_token_files(documents, folder, tokenizer_path, end_id, dtype)
    return read_token_files(spark, folder, dtype)
