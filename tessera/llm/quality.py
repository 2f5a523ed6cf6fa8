"""Quality classifier: naive Bayes support vectors.

A text is the set of its hashed byte four-grams (A-Z lowered) and two more indicators for its variety,
the shares of different four-grams and of different words at its length. Indicators are scaled by
the log ratio of their smoothed counts in the two classes, counted over all labelled training rows;
the scaled vector has length one. A linear hinge-loss model is then fitted by dual coordinate descent on a bounded sample,
and its margin becomes a probability by a logistic curve fitted on the sample's other part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, row_udf

BITS = 16
GRAMS = 1 << BITS
#: Indicators: four-grams, then either variety in tenths by the binary logarithm of the length.
FEATURES = GRAMS + 2 * 11 * 32
#: Labelled rows of each class that the linear model is fitted on, about; counts cover all rows.
SAMPLE_PER_CLASS = 4096
#: Up to so many labels are broadcast to the documents (about 60 bytes each); more are joined by a shuffle.
BROADCAST_LABELS = 500_000
EPOCHS, COST = 12, 1.0


class Grams:
    """Distinct features of a text, ascending order not guaranteed; the scratch array is reused."""

    def __init__(self) -> None:
        self.at = np.zeros(GRAMS, np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        low = text.encode().translate(LOWER) if text else b""
        words = low.split()
        x = np.frombuffer(low, np.uint8).astype(np.uint32)
        if len(x) < 4:
            x = np.concatenate((x, np.zeros(4 - len(x), np.uint32)))
        h = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        n = np.arange(len(h))
        self.at[h] = n
        own = h[self.at[h] == n].astype(np.int32)
        grams = GRAMS + 32 * (10 * len(own) // len(h)) + min(31, len(h).bit_length())
        different = GRAMS + 32 * (11 + 10 * len(set(words)) // max(1, len(words))) + min(31, len(words).bit_length())
        return np.append(own, np.array([grams, different], np.int32))


@dataclass(frozen=True)
class QualityModel:
    ratio: np.ndarray  # log-count ratio of each feature
    weight: np.ndarray  # linear model over the scaled features
    bias: float
    slope: float  # logistic curve over the margin
    offset: float

    def margin(self, features: np.ndarray) -> float:
        r = self.ratio[features]
        return float(r @ self.weight[features] / max(np.sqrt(r @ r), 1e-9)) + self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.offset, -500, 500))))


def log_count_ratios(rows: DataFrame, text: str, label: str) -> tuple[np.ndarray, tuple[int, int]]:
    """Smoothed log-count ratio of each feature over all ``rows``, and the class sizes. Tasks count
    into arrays; what is shuffled and gathered has the size of the feature space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = Grams(), np.zeros((2, FEATURES + 1), np.int64)
        for batch in batches:
            for t, y in zip(batch[0], batch[1]):
                own = n[y.as_py()]
                own[grams(t.as_py())] += 1
                own[FEATURES] += 1
        used = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[0, used]), pa.array(n[1, used])], names=["f", "n0", "n1"])

    counted = rows.select(text, label).mapInArrow(count, "f bigint, n0 bigint, n1 bigint")
    got = np.array([tuple(r) for r in counted.groupBy("f").agg(F.sum("n0"), F.sum("n1")).toLocalIterator()], np.int64).reshape(-1, 3)
    n = np.zeros((2, FEATURES + 1))
    n[:, got[:, 0]] = got[:, 1:].T
    p = n[:, :FEATURES] + 1
    p /= p.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0]), (int(n[0, FEATURES]), int(n[1, FEATURES]))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = COST,
                            epochs: int = EPOCHS, seed: int = 42) -> np.ndarray:
    """Weights of ``size`` features that minimise ``|w|^2 / 2 + cost * sum(max(0, 1 - y w.x))``; a row
    is ``(features, values)``, ``y`` is -1 or 1. One dual variable at a time is set to its optimum."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    square = [float(v @ v) for _, v in rows]
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            f, v = rows[i]
            a = min(max(alpha[i] - (y[i] * float(w[f] @ v) - 1) / square[i], 0.0), cost)
            if a != alpha[i]:
                w[f] += (a - alpha[i]) * y[i] * v
                moved = max(moved, abs(a - alpha[i]))
                alpha[i] = a
        if moved < 1e-3 * cost:
            break
    return w


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic regression of ``y`` (0 or 1) on the margin, by Newton
    steps with a little shrinkage of the slope."""
    x = np.stack((margin, np.ones(len(margin))), axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + [1e-2 * (b[0] - 1), 1e-6 * b[1]]
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        sample_per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """Model of ``labels`` (rows with label 0 or 1; others and null ids are left out, and so are
    labels of documents that are missing).

    Ratios are counted over every labelled document. The linear model is fitted on those whose hashed
    id falls below ``sample_per_class`` over the class size, about that many of each class: three
    quarters for the weights, the rest, weighted back to the class sizes, for the logistic curve.
    With a single class the score is that class; without labels it is one half.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__d"), F.col(label).cast("int").alias("__y"))
    small = known.count() <= BROADCAST_LABELS
    rows = docs.select(F.col(doc_id).alias("__i"), F.col(text).alias("__t"))
    rows = rows.join(F.broadcast(known) if small else known, F.col("__i") == F.col("__d")).select("__i", "__t", "__y")
    ratio, sizes = log_count_ratios(rows, "__t", "__y")
    if not all(sizes):
        bias = 0.0 if not any(sizes) else 20.0 if sizes[1] else -20.0
        return QualityModel(ratio, np.zeros(FEATURES), bias, 1.0, 0.0)

    def start() -> Callable[[str | None], bytes]:
        grams = Grams()
        return lambda t: grams(t).tobytes()

    share = F.when(F.col("__y") == 1, sample_per_class / sizes[1]).otherwise(sample_per_class / sizes[0])
    place = F.pmod(F.xxhash64(F.col("__i"), F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(place < share).select("__i", "__y", row_udf("binary", start)(F.col("__t")).alias("f"))
    got = sorted((r["__i"], r["__y"], bytes(r["f"])) for r in sample.toLocalIterator())
    x: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, f in got:
        f = np.frombuffer(f, np.int32)
        r = ratio[f]
        x.append((np.append(f, FEATURES), np.append(r / max(np.sqrt(r @ r), 1e-9), 1.0)))  # the last one is the bias
    y = np.array([label for _, label, _ in got])
    part = np.arange(len(got)) % 4 == 3
    w = dual_coordinate_descent([v for v, p in zip(x, part) if not p], np.where(y[~part] == 1, 1, -1), FEATURES + 1)
    margin = np.array([float(w[f] @ v) for f, v in x])
    weight = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    weight = weight / weight.mean()
    use = part if len(set(y[part])) == 2 else np.ones(len(y), bool)
    slope, offset = _logistic(margin[use], y[use], weight[use])
    return QualityModel(ratio, w[:-1], float(w[-1]), slope, offset)


def score(spark: SparkSession, model: QualityModel, text: Column) -> Column:
    """Probability of label 1 for each text, in 0 to 1; null and empty texts get the model's value for
    a text without content. The model (about 1 MB, whatever the data) is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    def start() -> Callable[[str | None], float]:
        grams, m = Grams(), shared.value
        return lambda t: m.score(grams(t))

    return row_udf("double", start)(text)


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold`` (null id: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` whose score is at least ``threshold``, by a model of the labelled ones outside fold 0
    of 5. All columns pass through; repeated rows share their score."""
    model = fit(spark, docs, labels.where(~held_out(doc_id, 5, 0)), doc_id, text)
    return docs.where(score(spark, model, F.col(text)) >= threshold)
