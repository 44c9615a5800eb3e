"""Quality of a text by how much better one of two zstandard dictionaries compresses it.

One dictionary is trained on pieces of texts labelled good, one on pieces of texts labelled bad.
A text is cut into pieces, so that the dictionaries count all along it and not only at its start;
the difference of the compressed sizes over their sum is its figure, and a logistic curve fitted
on other labelled texts turns that into the probability of label 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import byte_texts

PIECE = 1024
DICTIONARY = 65_536
LEVEL = 3
#: The bounded samples that are fitted on: labelled texts of each class for the dictionaries, the
#: pieces of them, and labelled texts of either class for the curve.
CLASS_DOCS = 3000
CLASS_PIECES = 6000
CURVE_DOCS = 6000
THRESHOLD = 0.3


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo `parts`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def pieces(text: bytes) -> list[bytes]:
    return [text[at:at + PIECE] for at in range(0, len(text), PIECE)]


def train_dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself
        return b"".join(samples)[-DICTIONARY:]


@dataclass(frozen=True)
class Model:
    """Dictionaries (None where a class has no sample), and the curve over the scaled figure."""

    good: bytes | None
    bad: bytes | None
    slope: float = 0.0
    intercept: float = 0.0

    def figures(self):
        """A function from texts to figures; 0 without both dictionaries and for empty texts."""
        if not self.good or not self.bad:
            return lambda texts: [0.0] * len(texts)
        pair = []
        for content in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False,
                                                 write_checksum=False, write_dict_id=False))

        def sizes(text: bytes) -> float:
            good = bad = 0
            for piece in pieces(text):
                good += len(pair[0].compress(piece))
                bad += len(pair[1].compress(piece))
            return (bad - good) / (good + bad) if text else 0.0

        return lambda texts: [sizes(t) for t in texts]

    def score(self, figure: float) -> float:
        z = self.slope * figure + self.intercept
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int32()), ("piece", pa.binary())])
    for batch in batches:
        rows = [(i, at, p) for i, t in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text"))) for at, p in enumerate(pieces(t))]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _figures_of(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("figure", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figures = model.figures()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"),
                                              pa.array(figures(byte_texts(batch.column("text"))), pa.float64())], schema=schema)

    return run


def _scores_of(model: Model, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figures = model.figures()
        for batch in batches:
            scores = [model.score(x) for x in figures(byte_texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                                              pa.array([int(s >= threshold) for s in scores], pa.int32())], schema=schema)

    return run


def fit_curve(figures: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve, by Newton's method with a slight pull to 0."""
    spread = figures.std() or 1.0
    x = np.column_stack([(figures - figures.mean()) / spread, np.ones(len(figures))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (labels - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] / spread), float(w[1] - w[0] * figures.mean() / spread)


def fit(documents: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """Learn from labelled documents outside remainder 0: the last remainder is for the curve, the
    others for the dictionaries. Samples are the labels with the smallest id hashes, so a rerun
    takes the same; where several rows label a document, the lowest label counts."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min("quality").cast("int").alias("quality")).withColumn("part", remainder(F.col("doc_id"), folds)).where("part <> 0")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    by_chance = [F.xxhash64("doc_id"), F.col("doc_id")]

    def sample(which: DataFrame, rows: int) -> DataFrame:
        return texts.join(F.broadcast(which.select("doc_id", "quality").orderBy(*by_chance).limit(rows)), "doc_id")  # at most `rows` pairs

    content = []
    for quality in (1, 0):
        chosen = sample(known.where((F.col("part") < folds - 1) & (F.col("quality") == quality)), CLASS_DOCS).select("doc_id", "text")
        parts = chosen.mapInArrow(_pieces_of, "doc_id long, place int, piece binary")
        taken = parts.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place", "piece").limit(CLASS_PIECES).collect()
        content.append(train_dictionary([bytes(r["piece"]) for r in taken]) if taken else None)
    model = Model(*content)
    seen = sample(known.where(F.col("part") == folds - 1), CURVE_DOCS).select("doc_id", "quality", "text").mapInArrow(
        _figures_of(model), "doc_id long, quality int, figure double").orderBy("doc_id", "figure").collect()
    if not seen:
        return model
    x, y = np.array([r["figure"] for r in seen]), np.array([r["quality"] for r in seen], float)
    return Model(*content, *fit_curve(x, y))


def quality_scores(documents: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (probability of label 1), predicted.

    Held out are documents whose id has remainder 0. Only texts are scored; labels are read for the
    fit alone. Null and empty texts have the figure 0 and so the score of a text that neither
    dictionary favours; so has every text if a class has no sample. Without any labels the score
    is 0.5. Repeated rows are scored alike; an empty table gives no rows.
    """
    model = fit(documents, labels, folds)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), (remainder(F.col("doc_id"), folds) == 0).alias("held_out"),
                            F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores_of(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
