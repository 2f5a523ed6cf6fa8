"""Whitening of embeddings by principal components in mixed precision.

Vectors are scaled to integers, so counts, sums and second moments are exact and the same in any
layout: one pass sums, a second adds up products of the integers centred at the rounded mean. The
covariance that follows is a matrix of dimension x dimension rationals. Its eigenvectors are
computed in float32 and corrected by Ogita and Aishima's iterations, which need nothing but
matrix products, in extended precision. Eigenvalues too close for the iteration to tell apart form
clusters; the matrix restricted to such a cluster is shifted and solved on its own, again from
float32, and the iterations go on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize

SCALE, OFFSET = 1024, 100_000
#: Entries beyond this size after scaling would leave 64-bit sums; they are an error.
MOST = 1 << 40
BLOCK_ROWS = 4096
#: The higher precision of the corrections: 64 bits of mantissa on x86, at least that of double elsewhere.
HIGHER = np.longdouble
ROUNDS = 40


def usable(embedding: str) -> F.Column:
    """Whether a vector is there, not empty, and without null, NaN and infinite entries."""
    c = F.col(f"`{embedding}`")
    odd = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) > 0) & ~odd, F.lit(False))


def _scaled(vectors: pa.ListArray) -> np.ndarray:
    """The rows of a batch (all of one length) as integers ``floor(SCALE * c) + OFFSET``."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(SCALE * flat)
    if len(x) and np.abs(x).max() >= MOST:
        raise ValueError(f"An embedding entry is beyond {MOST // SCALE} in size.")
    return (x.astype(np.int64) + OFFSET).reshape(len(vectors), -1)


def _product(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of integers as Python integers. Blocks whose sums stay below 2**53 go through float64, exactly."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), BLOCK_ROWS):
        part = y[at:at + BLOCK_ROWS]
        if int(np.abs(part).max(initial=0)) ** 2 * len(part) < 1 << 53:
            f = part.astype(np.float64)
            total += (f.T @ f).astype(np.int64).astype(object)
        else:
            total += part.T.astype(object) @ part.astype(object)
    return total


@dataclass
class Moments:
    n: int
    sums: list[int]
    cov: np.ndarray  # HIGHER


def moments(vectors: DataFrame) -> Moments:
    """Exact count, sums and covariance of ``vectors(v)``, arrays of one length.

    A task returns its sums and then one row for each pair of dimensions (dimension^2 / 2 rows, whatever
    its input), which are added up as decimals; the result is one number for each pair.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, None
        for b in batches:
            if b.num_rows:
                x = _scaled(b.column(0))
                n += len(x)
                s = x.sum(axis=0) + (0 if s is None else s)
        if n:
            k = np.arange(len(s) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.append(s, n))], names=["i", "v"])

    found = dict(vectors.mapInArrow(sums, "i int, v bigint").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    if not found:
        return Moments(0, [], np.zeros((0, 0), HIGHER))
    d = len(found) - 1
    n, total = int(found[d]), [int(found[i]) for i in range(d)]
    near = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    upper = np.triu_indices(d)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            if b.num_rows:
                p = _product(_scaled(b.column(0)) - near)
                own = p if own is None else own + p
        if own is not None:
            values = pa.array([str(x) for x in own[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), values], names=["i", "j", "v"])

    second = vectors.mapInArrow(products, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    rest = [s - n * int(m) for s, m in zip(total, near)]  # sums about the rounded mean
    cov = np.zeros((d, d), HIGHER)
    for i, j, v in second:
        whole, part = divmod(n * int(v) - rest[i] * rest[j], n * n)
        cov[i, j] = cov[j, i] = HIGHER(whole) + HIGHER(float(Fraction(part, n * n)))
    return Moments(n, total, cov)


def _low(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors in float32, of the matrix scaled to entries of at most one."""
    size = np.abs(a).max()
    values, vectors = np.linalg.eigh((a / size if size > 0 else a).astype(np.float32))
    return values.astype(HIGHER) * size, vectors.astype(HIGHER)


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: eigenvalues, corrected vectors, and the distance below which it cannot tell
    two eigenvalues apart (such pairs are made orthogonal only)."""
    r = np.eye(len(a), dtype=HIGHER) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    delta = 2 * (np.linalg.norm((s - np.diag(values)).astype(np.float64)) + np.linalg.norm(a.astype(np.float64)) * np.linalg.norm(r.astype(np.float64)))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > delta
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return values, x + x @ e, float(delta)


def clusters(values: np.ndarray, delta: float) -> list[np.ndarray]:
    """Runs of two and more eigenvalues whose neighbours are at most ``delta`` apart."""
    order = np.argsort(values, kind="stable")
    cut = np.flatnonzero(np.diff(values[order]) > delta) + 1
    return [part for part in np.split(order, cut) if len(part) > 1]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, in the higher precision.

    Vectors of eigenvalues that agree to its last digits are any orthonormal basis of their space.
    """
    a = np.asarray(a, HIGHER)
    if not len(a) or not np.abs(a).max() > 0:
        return np.zeros(len(a), HIGHER), np.eye(len(a), dtype=HIGHER)
    values, x = _low(a)
    eps = float(np.finfo(HIGHER).eps) * len(a)
    floor = eps * float(np.linalg.norm(a.astype(np.float64)))
    last = np.inf
    for _ in range(ROUNDS):
        values, x, delta = refine(a, x)
        if delta <= 8 * floor or delta > last / 2 and not len(clusters(values, delta)):
            break
        if delta > last / 16:  # what is left is inside the clusters: solve each on its own
            for part in clusters(values, delta):
                own = x[:, part]
                mu = values[part].mean()
                inner = own.T @ (a @ own - mu * own)
                inner = (inner + inner.T) / 2
                if np.abs(inner).max() > floor:
                    x[:, part] = own @ _low(inner)[1]
        last = delta
    x = x @ (1.5 * np.eye(len(a), dtype=HIGHER) - x.T @ x / 2)  # the last steps may leave small vectors a little oblique
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def whiten(spark: SparkSession, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
           components: int = 8) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each usable row and component.

    ``n`` is the number of usable vectors, ``deviation`` (decimal) the exact sum over dimensions of
    (n x - S)^2 for the integer vector x and the sums S, ``whitened`` the centred vector's projection on the component
    over the root of its eigenvalue, ``explained`` the eigenvalue's share, ``identity_error`` the largest entry
    by size of the covariance of the whitened values minus the identity, measured on what is returned.

    Null vectors, empty ones, and vectors with null, NaN or infinite entries are dropped. So are those of another
    length than most have (of equally many the longer), as if their missing entries were null. Repeated rows
    count and return as often as they occur; null ids stay; other columns are not read. Components of no variance
    (eigenvalue below rounding error) cannot be whitened and do not exist: fewer rows then, none for an
    empty table or when all vectors are equal. Entries of 2**30 and more in size are an error. The driver holds
    one dimension x dimension matrix and no vector.
    """
    rows = vectors.where(usable(embedding)).select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("v"))
    lengths = Counter({r["d"]: r["count"] for r in rows.groupBy(F.size("v").alias("d")).count().collect()})
    d = max(lengths, key=lambda k: (lengths[k], k), default=0)
    rows = rows.where(F.size("v") == d)
    m = moments(rows.select("v"))
    values, x = eigen(m.cov)
    trace = values.sum() if m.n else HIGHER(0)
    k = int((values[:components] > len(values) * float(np.finfo(np.float64).eps) * float(trace)).sum()) if trace > 0 else 0
    kind = f"{rows.schema['vec_id'].dataType.simpleString()}"
    if not k:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    n, sums = m.n, m.sums
    basis = (x[:, :k] / np.sqrt(values[:k]) / n).astype(np.float64)
    explained = [float(v / trace) for v in values[:k]]
    small = all(n * (MOST + OFFSET) + abs(s) < 1 << 62 for s in sums)

    @F.arrow_udf("struct<deviation: decimal(38,0), w: array<double>>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            xs = _scaled(b)
            big = not small and int(np.abs(xs).max(initial=0)) * n + max(map(abs, sums)) >= 1 << 62
            c = xs.astype(object) * n - np.array(sums, object) if big else xs * n - np.array(sums, np.int64)
            f = c.astype(np.float64)
            fits = (np.abs(f).max(initial=0) ** 2) * d < 2.0 ** 62
            c = c.astype(np.int64 if fits else object)
            squares = (c * c).sum(axis=1)
            deviation = pa.array(squares if fits else list(map(Decimal, squares))).cast(pa.decimal128(38, 0))
            w = f @ basis
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.StructArray.from_arrays([deviation, flat], names=["deviation", "w"])

    done = rows.select("vec_id", project("v").alias("p")).select("vec_id", "p.deviation", "p.w")
    done = materialize(spark, done, "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = done.agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))
    share = F.element_at(F.array(*map(F.lit, explained)), F.col("component"))
    long = done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return long.select("vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                       share.alias("explained"), F.lit(float(error)).alias("identity_error"))
