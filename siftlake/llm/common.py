"""Words, hashes and shared folders for the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.session import ensure_checkpoint_dir

#: Words are runs of anything but space and the ASCII controls from tab to carriage return.
SPACE_PATTERN = "[ \\t-\\r]+"
#: A cache of word hashes starts anew when it holds this many words; it only saves time.
CACHE_WORDS = 400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_list(text: Column) -> Column:
    """The words of a text; none for null, empty and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without keeping them: the pieces between white space less the empty
    ones, which only stand at the ends."""
    whole = F.coalesce(text, F.lit(""))
    pieces = F.split(whole, SPACE_PATTERN)
    empty_first = whole.rlike("^[ \\t-\\r]").cast("int")
    empty_last = whole.rlike("[ \\t-\\r]\\z").cast("int")
    blank = whole.rlike("^[ \\t-\\r]*\\z")
    return F.when(blank, 0).otherwise(F.size(pieces) - empty_first - empty_last).cast("bigint")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty. `split()` and `lower()` of bytes know ASCII only,
    so `text.split()` gives exactly the words of SPACE_PATTERN."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of each word, computed once per word while the cache holds it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, in order, from the hashes of the words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ words[j:n + j]) * _MIX
        h ^= h >> _SHIFT
    return h


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingles, sorted; fewer words are one shingle, no words none."""
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else np.empty(0, np.uint64)


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one all machines share, as a URI with its scheme."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir().rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{purpose}-{uuid.uuid4().hex}")
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file:///") else uri


def stored(df: DataFrame) -> DataFrame:
    """Run a plan once and cut its lineage in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Run a plan once and read it back from a table in the shared folder.

    Unlike a checkpoint the table has a true size, so plans that use it again and again (loops)
    are not sized by the product of all their sides.
    """
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
