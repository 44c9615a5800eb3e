"""Ranked lexical search by branch and bound over frequency-ordered document tries.

Documents are reduced to the terms that some item asks for, ordered from the most to the least
frequent, so that documents share the paths of a trie from its root. A node keeps the largest tf
of each term and the smallest length norm m below it. A score only grows with tf and falls with
m, so these give an upper bound for every document of the subtree; each item descends depth
first into the child with the highest bound and leaves what cannot reach its k-th best score.

Tries are built per task over blocks of bounded size; each task sends its best documents per
item, the best of all tasks are the result. Items come in blocks of a bounded number of terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import ascii_lower, byte_texts, written

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Terms of all items of a block; more items make more blocks, each a pass over the documents.
BLOCK_TERMS = 200_000
#: Document terms that are in one trie at a time.
TRIE_TERMS = 2_000_000
#: Subtrees of at most so many documents are scored whole.
LEAF = 32
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def text_terms(text: Column) -> Column:
    """The terms of a text in order: runs of ASCII letters, digits and everything not ASCII."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda t: t != "")


def _vectors(vocabulary: dict[bytes, int]):
    numbers = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", numbers), ("tfs", numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in byte_texts(batch.column("text")):
                words = text.translate(_TERM_BYTES).split()
                found = Counter(filter(vocabulary.__contains__, words))
                sizes.append(len(words))
                terms.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
                tfs.append(np.fromiter(found.values(), np.int32, len(found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, numbers), pa.array(tfs, numbers)],
                                             schema=schema)

    return run


def part(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """What an occurrence count adds to a score, before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Trie:
    """Documents by their terms, the most frequent first, as ranges of the documents in path order.

    `starts`, `terms`, `tfs` hold each document's terms one after the other. Paths along which no
    documents part are one node. Arrays of a node: its range of documents, its first child and
    number of children (none: a leaf), and one sorted key per (node, term) with the upper bound
    of what the term adds below it.
    """

    def __init__(self, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, norms: np.ndarray, n_terms: int):
        n = len(norms)
        sizes = np.diff(starts)
        doc = np.repeat(np.arange(n), sizes)
        order = np.lexsort((terms, doc))
        terms, tfs = terms[order], tfs[order]
        rank, ranges = self._paths(starts[:-1], sizes, terms, n_terms)
        self.docs = np.argsort(rank, kind="stable")
        sizes = sizes[self.docs]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(starts[self.docs] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.terms, tfs, self.norms = terms[take], tfs[take].astype(np.int64), norms[self.docs]
        self.parts = part(tfs, np.repeat(self.norms, sizes))
        self.n_terms = n_terms
        self._nodes(ranges, tfs)

    @staticmethod
    def _paths(first: np.ndarray, sizes: np.ndarray, terms: np.ndarray, n_terms: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The rank of each document's path, and for each depth where paths part the number of
        documents in each node."""
        rank, depth, levels = np.zeros(len(sizes), np.int64), 0, []
        many = np.ones(len(sizes), bool)
        while True:
            going = many & (sizes > depth)
            if not going.any():
                return rank, levels
            step = np.zeros(len(sizes), np.int64)
            step[going] = terms[first[going] + depth] + 1
            _, rank, counts = np.unique(rank * (n_terms + 1) + step, return_inverse=True, return_counts=True)
            if len(counts) > (len(levels[-1]) if levels else 1):
                levels.append(counts)
            many = counts[rank] > LEAF
            depth += 1

    def _nodes(self, levels: list[np.ndarray], tfs: np.ndarray) -> None:
        low, high = [np.zeros(1, np.int64)], [np.array([len(self.docs)])]
        ends, numbers, made = high[0], np.zeros(1, np.int64), 1  # the last level's ranges and their nodes
        keys, bounds, parents = [], [], []
        self._bound(numbers, low[0], high[0], tfs, keys, bounds)
        for counts in levels:
            new_ends = np.cumsum(counts)
            new_low = new_ends - counts
            above = np.searchsorted(ends, new_low, side="right")
            parted = np.bincount(above, minlength=len(ends))
            new = parted[above] > 1
            ids = numbers[above]
            ids[new] = made + np.arange(int(new.sum()))
            split = np.flatnonzero(parted > 1)
            parents.append((numbers[split], ids[np.searchsorted(above, split)], parted[split]))
            made += int(new.sum())
            low.append(new_low[new])
            high.append(new_ends[new])
            self._bound(ids[new], low[-1], high[-1], tfs, keys, bounds)
            ends, numbers = new_ends, ids
        self.low, self.high = np.concatenate(low), np.concatenate(high)
        self.child, self.children = np.zeros(made, np.int64), np.zeros(made, np.int64)
        for parent, first, n in parents:
            self.child[parent], self.children[parent] = first, n
        # Nodes are numbered level by level, so the keys of all are in order.
        self.keys, self.bounds = np.concatenate(keys), np.concatenate(bounds)

    def _bound(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray, tfs: np.ndarray, keys: list, bounds: list) -> None:
        """Largest tf of each term and least norm below each of some nodes, in document order."""
        sizes = self.starts[high] - self.starts[low]
        ends = np.cumsum(sizes)
        entries = np.repeat(self.starts[low] - (ends - sizes), sizes) + np.arange(ends[-1])
        key = np.repeat(ids, sizes) * self.n_terms + self.terms[entries]
        order = np.argsort(key, kind="stable")
        key, tf = key[order], tfs[entries][order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ranges = np.stack([low, high], axis=1).ravel()
        least = np.minimum.reduceat(np.append(self.norms, np.iinfo(np.int64).max), ranges)[::2]
        keys.append(key[first])
        node = np.repeat(np.arange(len(ids)), sizes)[order][first]
        bounds.append(part(np.maximum.reduceat(tf, first), least[node]))

    def upper(self, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores that no document below a node can exceed."""
        wanted = nodes[:, None] * self.n_terms + terms
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.bounds[at] * weights, 0).sum(axis=1)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: list[tuple], key_of) -> list[tuple]:
        """`best` (score, key) of an item so far, the highest first, with this trie's documents."""
        dense = np.zeros(self.n_terms, np.int64)
        dense[terms] = weights
        stack = [(int(self.upper(np.zeros(1, np.int64), terms, weights)[0]), 0)]
        while stack:
            bound, node = stack.pop()
            least = best[k - 1][0] if len(best) >= k else 1
            if bound < max(least, 1):
                continue
            if self.children[node]:
                below = self.child[node] + np.arange(self.children[node])
                uppers = self.upper(below, terms, weights)
                order = np.argsort(uppers, kind="stable")
                order = order[uppers[order] >= max(least, 1)]
                stack += zip(uppers[order].tolist(), below[order].tolist(), strict=True)
                continue
            low, high = self.low[node], self.high[node]
            a, b = self.starts[low], self.starts[high]
            scores = np.add.reduceat(dense[self.terms[a:b]] * self.parts[a:b], self.starts[low:high] - a)
            found = np.flatnonzero(scores >= max(least, 1))
            if len(found):
                if len(found) > k:  # equal scores stay: the key decides between them
                    cut = np.partition(scores[found], len(found) - k)[len(found) - k]
                    found = found[scores[found] >= cut]
                best = sorted(best + [(int(scores[i]), key_of(self.docs[low + i])) for i in found], key=lambda s: (-s[0], s[1]))[:k]
        return best


def _search(items: list[tuple[int | None, np.ndarray, np.ndarray]], order: np.ndarray, n_docs: int, n_words: int, k: int):
    """Best documents of a task for each of (item, terms, weights); terms as places in `order`."""
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def tries(batch: pa.RecordBatch) -> Iterator[tuple[Trie, list]]:
        lists, tf_lists = batch.column("terms"), batch.column("tfs")
        starts = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
        terms, tfs = order[np.asarray(lists.flatten())], np.asarray(tf_lists.flatten())
        ids = batch.column("doc_id").to_pylist()
        # As whole numbers of any size: 90 * n * N can pass 64 bits.
        norms = np.array([10 + 90 * n * n_docs // n_words for n in batch.column("n").to_pylist()], np.int64)
        at = 0
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + TRIE_TERMS, side="right")) - 1)
            a, b = starts[at], starts[end]
            yield Trie(starts[at:end + 1] - a, terms[a:b], tfs[a:b], norms[at:end], len(order)), ids[at:end]
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        for batch in batches:
            if not len(batch):
                continue
            for trie, ids in tries(batch):
                key_of = lambda doc, ids=ids: (ids[doc] is None, ids[doc] or 0)
                for i, (_, terms, weights) in enumerate(items):
                    best[i] = trie.search(terms, weights, k, best[i], key_of)
        rows = [(item, None if key[0] else key[1], score) for (item, _, _), found in zip(items, best, strict=True) for score, key in found]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _block(documents: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Documents for the items of one block, at least the k best of each: item_id, doc_id, score."""
    asked = pairs.toArrow()  # bounded: see BLOCK_TERMS
    vocabulary = {t: i for i, t in enumerate(sorted(set(asked["term"].cast(pa.binary()).to_pylist())))}
    vectors = written(documents.mapInArrow(_vectors(vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>"))
    n_docs, n_words = vectors.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    figures = frequency.select("term", "df", weight.cast("bigint").alias("w")).toArrow()  # one row a term
    dfs, weights = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    dfs[figures["term"].to_numpy()] = figures["df"].to_numpy()
    weights[figures["term"].to_numpy()] = figures["w"].to_numpy()
    order = np.empty(len(vocabulary), np.int64)
    order[np.argsort(-dfs, kind="stable")] = np.arange(len(vocabulary))
    terms_of: dict[int | None, list[int]] = {}
    for item, term in zip(asked["item_id"].to_pylist(), asked["term"].cast(pa.binary()).to_pylist(), strict=True):
        number = vocabulary[term]
        if weights[number] > 0:  # a weight of 0 adds nothing to any score
            terms_of.setdefault(item, []).append(number)
    items = [(item, order[numbers], weights[numbers]) for item, numbers in terms_of.items()]
    return vectors.where("size(terms) > 0").mapInArrow(_search(items, order, n_docs, n_words, k), "item_id long, doc_id long, score long")


def lexical_search(documents: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters, digits and everything that is not ASCII; only A-Z is
    lower-cased. With N documents that have terms, L terms in all, n of one document, df
    documents with a term and tf occurrences, a term weighs `floor(1000 ln((2N+2)/(2df+1)))`, a
    document has m = `10 + 90nN div L`, and scores the sum over the item's distinct terms of
    `weight * (10^9 tf div (1000 tf + 8m))`. Equal scores stand by ascending doc_id.

    Null and empty texts have no terms: such documents are not counted and never found, such
    items give no rows, as does an empty table on either side. Rows that share an item_id (or
    have none) are one item with the terms of all. Repeated documents are documents of their own;
    those without doc_id come after equal scores. Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = written(items.select(F.col("item_id").cast("bigint").alias("item_id"), F.explode(text_terms(F.col("text").cast("string"))).alias("term")).distinct())
    blocks = max(1, -(-asked.count() // block_terms))
    in_block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = reduce(DataFrame.union, [_block(docs, asked.where(in_block == block), k) for block in range(blocks)])
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
