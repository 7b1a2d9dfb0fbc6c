"""Compression classifier: how much better a text compresses with a dictionary of good text than with
one of bad text, as a calibrated score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.llm.shared import documents_of, slices
from clientela.llm.words import batch, texts_of

# bytes compressed at a time, so that a long text does not become its own dictionary
CHUNK = 2048
_LEVEL = 3
_SCORED = pa.schema([("doc_id", pa.int64()), ("x", pa.float64())])


class Model:
    """Two dictionaries and the curve that turns a size difference into a probability."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = good, bad
        self.slope, self.shift = 0.0, 0.0

    def probability(self, x: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * x + F.lit(self.shift))))


def _difference(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
            if not dictionary:
                return zstandard.ZstdCompressor(level=_LEVEL)
            data = zstandard.ZstdCompressionDict(dictionary)
            data.precompute_compress(level=_LEVEL)
            return zstandard.ZstdCompressor(level=_LEVEL, dict_data=data)

        a, b = compressor(good), compressor(bad)
        for part in slices(batches, "text"):
            xs = []
            for t in texts_of(part.column("text")):
                more = less = 0
                for i in range(0, len(t), CHUNK):
                    piece = t[i : i + CHUNK]
                    more += len(b.compress(piece))
                    less += len(a.compress(piece))
                xs.append((more - less) / max(more, less) if t else 0.0)
            yield batch(_SCORED, part.column("doc_id"), xs)

    return run


def differences(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, x): normalised compressed-size difference of whole texts, in chunks; 0 of none."""
    return docs.mapInArrow(_difference(model.good, model.bad), "doc_id long, x double")


def _dictionary(texts: list[str], size: int) -> bytes:
    pieces = [p for t in texts for raw in [t.encode()] for p in (raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK))]
    total = sum(map(len, pieces))
    if total == 0:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), pieces, level=_LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to find anything in common
        return b"".join(pieces)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the likeliest logistic curve, lightly held to 0 (Newton's method)."""
    scale = float(np.abs(x).max()) or 1.0
    design = np.column_stack((x / scale, np.ones(len(x))))
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - 0.01 * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(documents: DataFrame, labels: DataFrame, dictionary_rows: int = 1000, calibration_rows: int = 20_000, size: int = 112_640) -> Model:
    """Learn from ``documents`` joined with ``labels`` (doc_id, label 0 or 1).

    Bounds: the dictionaries are made of the whole texts of at most ``dictionary_rows`` rows of each
    label, the curve is fitted on at most ``calibration_rows`` others, both drawn by a hash of the id. Without
    rows of both labels the score is the share of label 1 (or one half).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).filter("label IN (0, 1)").distinct()
    order = F.xxhash64("doc_id", F.lit(5))
    drawn, texts = {}, {}
    for label in (0, 1):
        drawn[label] = [r.doc_id for r in known.filter(F.col("label") == label).orderBy(order, "doc_id").limit(dictionary_rows).collect()]
        texts[label] = [r.text for r in documents_of(documents).filter(F.col("doc_id").isin(drawn[label])).select("text").collect()]
    model = Model(_dictionary(texts[1], size), _dictionary(texts[0], size))
    # an id of the dictionaries calibrates only where there are no others
    used = set(drawn[0]) | set(drawn[1])
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").limit(calibration_rows + len(used))
    rows = [(r.doc_id, r.label) for r in chosen.collect()]
    others = [r for r in rows if r[0] not in used]
    rows = (others if {y for _, y in others} == {0, 1} and len(others) >= 50 else rows)[:calibration_rows]
    if not rows:
        return model
    spark = documents.sparkSession
    wanted = F.broadcast(spark.createDataFrame(rows, "doc_id long, label int"))  # at most calibration_rows
    pairs = [(r.x, r.label) for r in differences(documents_of(documents).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), model).join(wanted, "doc_id").select("x", "label").collect()]
    if not pairs:
        return model
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
    if y.min() == y.max():
        model.shift = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    else:
        model.slope, model.shift = logistic(x, y)
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts have a difference of 0."""
    out = differences(documents_of(documents), model).select("doc_id", model.probability(F.col("x")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
