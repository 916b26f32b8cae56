"""Quality scores learned from preference pairs (Bradley-Terry).

A document with label 1 is preferred to one with label 0. The score of a
document is linear in features of its text; the chance that one document is
preferred to another is the logistic function of the difference of their
scores. Fitting minimises the logistic loss on feature differences of pairs. The
threshold is the quantile of the training scores at the share of label 0; it is
mapped to ``THRESHOLD``.

Fitting uses at most ``TRAIN_ROWS`` labelled rows and ``PAIRS`` pairs of them
(the documented bounds). Only the text is looked at.

Edge cases: null and empty texts have all features 0 and a score like any
other; null labels are not learned from; without rows of both labels every
score is the share of label 1; repeated documents are scored each time; labels
repeated for an id count once, the largest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lexigrove.llm.shared import pieces

THRESHOLD = 0.7
TRAIN_ROWS = 20_000
PAIRS = 100_000

_CLASSES = {
    "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "stop": b".,;:?", "shout": b"!", "bar": b"|\t",
    "sign": b"#$%&*@^~<>{}[]=+_\\/", "wide": bytes(range(128, 256)), "space": b" \n\r\t\x0b\x0c"}
FEATURES = ["words", "distinct", "most", "again", "length", "long", "single", "lines", "line_again", "line_words", *_CLASSES]


def features(text: bytes | None) -> list[float]:
    """Numbers about the form of a text."""
    if not text or not text.strip():
        return [0.0] * len(FEATURES)
    words = text.split()
    n = len(words)
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    total = len(text)
    return [
        np.log1p(n), len(counts) / n, max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        (total - n) / n, sum(len(w) > 20 for w in words) / n, sum(len(w) == 1 for w in words) / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        *((total - len(text.translate(None, c))) / total for c in _CLASSES.values())]


@dataclass
class Model:
    """Standardisation, weights, threshold of the raw score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    share: float | None = None

    def widened(self, table: np.ndarray) -> np.ndarray:
        z = np.clip((table - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z])

    def score(self, table: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(table), self.share)
        margin = self.widened(table) @ self.weights - self.threshold + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def with_features(docs: DataFrame, name: str = "features") -> DataFrame:
    """The documents, their text replaced by its features."""
    columns = [c for c in docs.columns if c not in ("text", name)]
    schema = docs.select(*columns).schema.add(name, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            made = pa.array([features(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), made], names=[*columns, name])

    return docs.select(*columns, "text").mapInArrow(run, schema)


def fit(table: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 5) -> Model:
    """Bradley-Terry weights from pairs of a label 1 and a label 0 row, by Newton's method."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    mean, scale = (table.mean(axis=0), table.std(axis=0) + 1e-9) if len(table) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    model = Model(mean, scale, np.zeros(2 * len(FEATURES)), 0.0)
    if not len(good) or not len(bad):
        model.share = float(np.mean(labels)) if len(labels) else 0.0
        return model
    draw = np.random.default_rng(seed)
    wide = model.widened(table)
    difference = wide[draw.choice(good, pairs)] - wide[draw.choice(bad, pairs)]
    weights = model.weights
    for _ in range(25):
        chance = 1 / (1 + np.exp(np.clip(difference @ weights, -500, 500)))
        slope = ridge * weights - difference.T @ chance / pairs
        bend = (difference * (chance * (1 - chance))[:, None]).T @ difference / pairs
        step = np.linalg.solve(bend + ridge * np.eye(len(weights)), slope)
        weights = weights - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    model.weights = weights
    model.threshold = float(np.quantile(wide @ weights, len(bad) / (len(good) + len(bad))))
    return model


def train(docs: DataFrame, labels: DataFrame, held_out=None, most: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``most`` labelled rows, chosen by a hash of the id."""
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    if held_out is not None:
        marks = marks.filter(~held_out)
    chosen = marks.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(most)
    rows = with_features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("label", "features").toArrow()
    flat = rows.column("features").combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0)
    return fit(flat.reshape(-1, len(FEATURES)), rows.column("label").to_numpy())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a ``score`` from 0 to 1."""
    columns = [c for c in docs.columns if c != "score"]
    schema = docs.select(*columns).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            table = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(table))], names=[*columns, "score"])

    return docs.select(*columns).mapInArrow(run, schema)
