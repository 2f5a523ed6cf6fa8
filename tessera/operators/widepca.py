"""Principal components of wide matrices (M7, M8) without a matrix of features by features.

A block of a few vectors more than components is improved in rounds until the wanted ones are eigenvectors. A round
applies the covariance to the residuals of the block, as two aggregates over the non-zero entries (``x . q`` summed up by
row and centred, then ``sum(x * y)`` by feature), and takes the best block of the space that the block, its
residuals and its last step span. The space is orthonormalised as a tall and skinny matrix: each partition adds up
the products of its columns, which are a few dozen numbers squared, and their sum alone reaches the driver.

Vectors are tables with a row for each feature and stay distributed, written to the shared folder in each round (so a lost
executor costs no earlier round). They are broadcast to the entries while they take less than ``BROADCAST_BYTES``, else
joined. Only the finished loadings, ``k`` numbers a feature, are a part of the model and held by whoever applies it.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.dictionary import _written

#: Vectors of a block beyond the components, bound of the residuals (against the largest eigenvalue), rounds.
MORE, TOLERANCE, ROUNDS = 8, 1e-9, 500
BROADCAST_BYTES = 64 << 20


def entries_of(feats: DataFrame, features: str) -> DataFrame:
    """``(idx, val)``: positions and values of each row's vector, dense or sparse."""
    v = F.unwrap_udt(F.col(f"`{features}`"))
    rows = feats.select(v.alias("v"))
    every = F.expr("transform(v.values, (x, i) -> i)")
    return rows.select(F.coalesce("v.indices", every).alias("idx"), F.col("v.values").alias("val"))


class _Rows:
    """The matrix: numbered rows in a fixed partitioning, so that sums by row need no shuffle while vectors are broadcast."""

    def __init__(self, feats: DataFrame, features: str, broadcast_bytes: int):
        spark = feats.sparkSession
        numbered = _written(entries_of(feats, features).withColumn("row", F.monotonically_increasing_id()), "pca-rows")
        self.rows = numbered.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row").persist()
        self.n = self.rows.count()
        self.broadcast_bytes = broadcast_bytes

    def each(self, rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("row", *more, F.inline(F.arrays_zip("idx", "val"))).where("val <> 0")

    def moments(self) -> tuple[DataFrame, int, float]:
        """``(i, m)``: means of the features that are not zero everywhere; their number; the trace of the covariance."""
        sums = self.each(self.rows).groupBy(F.col("idx").alias("i")).agg(F.sum("val").alias("s"), F.sum(F.col("val") * F.col("val")).alias("s2"))
        sums = _written(sums, "pca-moments")
        spread = F.sum((F.col("s2") - F.col("s") * F.col("s") / self.n) / (self.n - 1))
        total = sums.agg(F.count(F.lit(1)), spread).first()
        return sums.select("i", (F.col("s") / self.n).alias("m")), total[0], float(total[1] or 0.0)

    def covariance_times(self, q: DataFrame, cols: list[str], centre: np.ndarray, out: list[str], features: int) -> DataFrame:
        """``(i, out...)``: the covariance applied to ``q(i, cols...)``; ``centre`` are the products of the means with ``cols``."""
        q = q.select("i", *cols)
        if features * 8 * (len(cols) + 1) <= self.broadcast_bytes:
            q = F.broadcast(q)
        y = self.each(self.rows).join(q, F.col("idx") == F.col("i")).groupBy("row").agg(
            *[(F.sum(F.col("val") * F.col(c)) - F.lit(float(m))).alias(c) for c, m in zip(cols, centre)])
        z = self.each(self.rows.join(y, "row"), *cols)
        return z.groupBy(F.col("idx").alias("i")).agg(*[(F.sum(F.col("val") * F.col(c)) / (self.n - 1)).alias(o) for c, o in zip(cols, out)])


def products(table: DataFrame, cols: list[str]) -> np.ndarray:
    """The matrix of all products of two columns, summed over the rows."""
    w = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((w, w))
        for b in batches:
            m = np.column_stack([b[c].to_numpy(zero_copy_only=False) for c in cols])
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(w * w, dtype=np.int32)), pa.array(total.ravel())], names=["at", "value"])

    out = np.zeros(w * w)
    for r in table.select(*cols).mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toLocalIterator():
        out[r["at"]] = r["value"]
    return out.reshape(w, w)


def combined(table: DataFrame, cols: list[str], by: np.ndarray, out: list[str]) -> DataFrame:
    """``(i, m, out...)``: the columns ``cols`` times the matrix ``by``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.column_stack([b[c].to_numpy(zero_copy_only=False) for c in cols]) @ by
            yield pa.RecordBatch.from_arrays([b["i"], b["m"], *[pa.array(np.ascontiguousarray(x)) for x in m.T]], names=["i", "m", *out])

    return table.select("i", "m", *cols).mapInArrow(run, "i int, m double, " + ", ".join(f"{c} double" for c in out))


def _best(gram: np.ndarray, image: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``b`` largest Ritz values and their coefficients, from the products of a basis with itself and with its image."""
    size = np.sqrt(np.diag(gram))
    use = size > 1e-14 * size.max()
    d = np.where(use, 1 / np.where(use, size, 1), 0.0)
    s, q = np.linalg.eigh(d[:, None] * gram * d)
    keep = s > 1e-12 * s.max()
    t = d[:, None] * (q[:, keep] / np.sqrt(s[keep]))
    values, u = np.linalg.eigh(t.T @ ((image + image.T) / 2) @ t)
    return values[::-1][:b], (t @ u)[:, ::-1][:, :b]


def principal_components(feats: DataFrame, features: str, k: int, tolerance: float = TOLERANCE, rounds: int = ROUNDS,
                         broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, np.ndarray, list[float], np.ndarray]:
    """``(loadings(i, v0, v1, ...), eigenvalues, shares of the variance, products of the means with the loadings)``.

    A feature that is zero in all rows has no row among the loadings. Components beyond the rank of the
    matrix have zero loadings and no share. One row, no row, or equal rows only: all shares are zero. The start
    follows from the features' numbers alone, so it does not depend on the layout.
    """
    x = _Rows(feats, features, broadcast_bytes)
    try:
        return _iterate(x, k, tolerance, rounds)
    finally:
        x.rows.unpersist()


def _iterate(x: _Rows, k: int, tolerance: float, rounds: int):
    spark = x.rows.sparkSession
    none = spark.createDataFrame([], "i int, " + ", ".join(f"v{j} double" for j in range(k))), np.zeros(k), [0.0] * k, np.zeros(k)
    if x.n < 2:
        return none
    means, present, trace = x.moments()
    b = min(k + MORE, present)
    if not b or trace <= 0:
        return none

    def names(letter: str) -> list[str]:
        return [f"{letter}{j}" for j in range(b)]

    v, cv, r, cr, p, cp = (names(c) for c in ("v", "cv", "r", "cr", "p", "cp"))

    def with_image(table: DataFrame, cols: list[str], out: list[str], centre: np.ndarray) -> DataFrame:
        image = x.covariance_times(table, cols, centre, out, present)
        return _written(table.join(image, "i"), "pca-block")

    start = means.select("i", "m", *[(F.xxhash64("i", F.lit(j)) / F.lit(2.0 ** 63)).alias(c) for j, c in enumerate(v)])
    start = _written(start, "pca-block")
    table = with_image(start, v, cv, products(start, ["m", *v])[0, 1:])
    basis, image, found, residual = v, cv, None, np.inf
    for _ in range(rounds):
        g = products(table, [*basis, *image])
        w = len(basis)
        values, u = _best(g[:w, :w], g[:w, w:], b)
        pad = b - len(values)  # the space has fewer dimensions than the block
        values, u = np.r_[values, np.zeros(pad)], np.hstack([u, np.zeros((w, pad))])
        last = u.copy()
        last[:b] = 0  # the step: what was not in the block before
        zero = np.zeros_like(u)
        both = np.vstack([np.hstack([u, zero, -u * values, last, zero]), np.hstack([zero, u, u, zero, last])])
        table = _written(combined(table, [*basis, *image], both, [*v, *cv, *r, *p, *cp]), "pca-block")
        g = products(table, ["m", *r, *v])
        found = table, values, g[0, 1 + b:]
        residual = float(np.sqrt(np.diag(g)[1:1 + min(k, b)].max()))
        if residual <= tolerance * values[0]:
            break
        table = with_image(table, r, cr, g[0, 1:1 + b])
        basis, image = [*v, *r, *p], [*cv, *cr, *cp]
    else:
        warnings.warn(f"principal components: residual {residual:.3g} after {rounds} rounds (largest eigenvalue {found[1][0]:.3g})", stacklevel=3)
    table, values, centre = found
    real = min(k, b)
    missing = [F.lit(0.0).alias(f"v{j}") for j in range(real, k)]
    values, centre = (np.r_[a[:real], np.zeros(k - real)] for a in (np.maximum(values, 0), centre))
    return table.select("i", *v[:real], *missing), values, [float(e / trace) for e in values], centre


class Projection(Transformer, MLReadable, MLWritable):
    """``outputCols[j]`` = vector in ``inputCol`` . loadings ``v<j>`` - ``offsets[j]``. ``loadings(i, v0, v1, ...)`` is saved with the
    stage; a feature without a row loads nothing."""

    inputCol = Param(Params._dummy(), "inputCol", "feature vector column", TypeConverters.toString)
    outputCols = Param(Params._dummy(), "outputCols", "score columns", TypeConverters.toListString)
    offsets = Param(Params._dummy(), "offsets", "products of the means with the loadings", TypeConverters.toListFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)

    def __init__(self, inputCol="features", outputCols=None, offsets=None, size=0, loadings: DataFrame | None = None):
        super().__init__()
        self._set(inputCol=inputCol, outputCols=list(outputCols or []), offsets=list(offsets or []), size=size)
        self.loadings, self._held = loadings, None

    def matrix(self) -> np.ndarray:
        """The loadings as ``size`` rows; these are the model's own numbers."""
        if self._held is None:
            rows = self.loadings.toPandas()
            self._held = np.zeros((self.getOrDefault(self.size), len(self.getOrDefault(self.outputCols))))
            self._held[rows["i"].to_numpy(np.int64)] = rows[[f"v{j}" for j in range(self._held.shape[1])]].to_numpy()
        return self._held

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        held = df.sparkSession.sparkContext.broadcast(self.matrix())
        outs, offsets = g(self.outputCols), np.array(g(self.offsets))

        @F.arrow_udf("array<double>")
        def project(idx: pa.Array, val: pa.Array) -> pa.Array:
            n = len(val)
            at, x = idx.flatten().to_numpy(zero_copy_only=False), val.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), np.asarray(val.value_lengths().to_numpy(zero_copy_only=False), np.int64))
            sums = [np.bincount(row, weights=x * w, minlength=n) - o for w, o in zip(held.value[at].T, offsets)]
            flat = np.column_stack(sums).ravel()
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(sums)), pa.array(flat))

        df = df.withColumn("__v", F.unwrap_udt(F.col(f"`{g(self.inputCol)}`")))
        df = df.withColumn("__pc", project(F.expr("coalesce(__v.indices, transform(__v.values, (x, i) -> i))"), F.col("__v.values")))
        return df.withColumns({c: F.col("__pc")[j] for j, c in enumerate(outs)}).drop("__v", "__pc")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: Projection):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc)
        self.instance.loadings.write.mode("overwrite").parquet(f"{path}/data")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Projection:
        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        out = self.cls(loadings=self.sparkSession.read.parquet(f"{path}/data"))
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out


def leading_sign(loadings: DataFrame, column: str) -> float:
    """+1 or -1, so that the loading of the largest magnitude (the first of those that tie within rounding) is positive."""
    c = F.col(column)
    top = loadings.agg(F.max(F.abs(c))).first()[0]
    if not top:
        return 1.0
    lead = loadings.where(F.abs(c) >= top * (1.0 - 1e-9)).agg(F.min_by(c, "i")).first()[0]
    return 1.0 if lead >= 0 else -1.0
