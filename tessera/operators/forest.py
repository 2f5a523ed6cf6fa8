"""Random forests of many trees (M2, M4) as a ``pyspark.ml`` Estimator / Model.

The algorithm is the library's: a Poisson(1) bootstrap count for each row and tree, up to ``maxBins`` bins a feature,
the split of the greatest impurity gain (variance; Gini is the sum of the variances of the class indicators) among all
features or a random ``ceil(sqrt)`` of them, leaves where no split gains or at the depth limit. A tree sees no more of a
row than its cell, the bins of its features. So the sums of weights and targets by tree and cell are all that growing
needs, however deep the tree.

Spark plan:
1. bins: the distinct values of each feature (midpoints split them), or quantiles of a sample beyond ``maxBins``
   values; then the distinct cells.
2. sums: one pass over the rows in their canonical layout. A task draws the counts of a batch of rows for all trees and
   adds them up by cell; no count is kept.
3. grow: ``groupBy("tree").applyInPandas`` adds the tasks' sums in the order of the tasks and grows the tree. A tree that
   drew no row (possible for a handful of rows) has no say.
4. predict: the node table is broadcast; rows of a batch that fall between the same thresholds are walked once.

``fit`` returns None where the sums of one task would be more than ``MOST_SUMS`` numbers: so many cells are the library's job.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_SUMS = 2_000_000  # trees x cells x target columns that a task adds up: 16 MB, and as much for the weights at most
MOST_FEATURES = 64
SAMPLED = 100_000  # rows for the quantiles
_DRAWN = 2_048  # rows whose counts are drawn at once
_BELOW = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])  # Poisson(1): the chance of k or less; 18 and more: 6e-17
_NOISE = 1e-24  # gains below this share of the largest squared target are rounding

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("value", T.ArrayType(T.DoubleType())),
])


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def bootstrap_counts(rng: np.random.Generator, rows: int, trees: int) -> np.ndarray:
    """Poisson(1) counts by inversion, row by row (several times as fast as the generator's own)."""
    u, out = rng.random((rows, trees)), np.zeros((rows, trees), dtype=np.int8)
    for share in _BELOW:
        out += u >= share
    return out


def midpoints(values: np.ndarray) -> np.ndarray:
    """Thresholds that separate sorted distinct values (``x <= threshold`` goes left)."""
    a, b = values[:-1], values[1:]
    mid = a + (b - a) / 2
    return np.where((mid >= a) & (mid < b), mid, a)


def bin_thresholds(x: DataFrame, laid: DataFrame, width: int, rows: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """Thresholds per feature of ``x`` (one column ``x``, array<double>). The distinct values are those of all rows; the
    quantiles of a feature with more of them come, as in the library, from a sample, drawn in the canonical layout."""
    def distinct(batches):
        seen = [np.zeros(0)] * width
        for batch in batches:
            m = _matrix(batch.column(0))
            seen = [s if len(s) > max_bins else np.unique(np.concatenate([s, m[:, f]]))[:max_bins + 1] for f, s in enumerate(seen)]
        yield pa.RecordBatch.from_pydict({"f": np.repeat(np.arange(width, dtype=np.int32), [len(s) for s in seen]),
                                          "v": np.concatenate(seen)})

    found = x.mapInArrow(distinct, "f int, v double").groupBy("f").agg(F.collect_set("v").alias("v")).collect()
    values = {r["f"]: np.unique(r["v"]) for r in found}
    many = [f for f in range(width) if len(values.get(f, ())) > max_bins]
    if many:
        shares = [i / max_bins for i in range(1, max_bins)]
        some = laid if rows <= SAMPLED else laid.sample(False, SAMPLED / rows, seed)
        row = some.agg(*[F.percentile(F.col("x")[f], shares).alias(f"q{f}") for f in many]).first()
        values.update({f: np.unique(row[f"q{f}"]) for f in many})
    return [values.get(f, np.zeros(0)) if f in many else midpoints(values.get(f, np.zeros(0))) for f in range(width)]


def cell_codes(m: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """One number for the bins of all features of each row."""
    code = np.zeros(len(m), dtype=np.int64)
    for f, t in enumerate(thresholds):
        code = code * (len(t) + 1) + np.searchsorted(t, m[:, f])
    return code


def cell_bins(codes: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    out, rest = np.zeros((len(codes), len(thresholds)), dtype=np.int64), codes.copy()
    for f in range(len(thresholds) - 1, -1, -1):
        rest, out[:, f] = np.divmod(rest, len(thresholds[f]) + 1)
    return out


def grow_tree(bins: np.ndarray, w: np.ndarray, s: np.ndarray, thresholds: list[np.ndarray], max_depth: int, n_features: int,
              rng: np.random.Generator) -> list[tuple]:
    """Node rows ``(node, left, right, feature, threshold, value)`` of one tree from its sums by cell: weights ``w`` (cells)
    and weighted targets ``s`` (cells x columns). A tree without a row has no nodes."""
    width, most = bins.shape[1], max(len(t) for t in thresholds) + 1
    used = np.flatnonzero(w > 0)
    if not len(used):
        return []
    noise = _NOISE * float(((s[used] / w[used, None]) ** 2).max())
    nodes: list[list] = []
    stack = [(used, 0, -1, 0)]
    while stack:
        idx, depth, parent, side = stack.pop()
        total = w[idx].sum()
        mean = s[idx].sum(axis=0) / total
        node = len(nodes)
        nodes.append([node, -1, -1, -1, 0.0, mean.tolist()])
        if parent >= 0:
            nodes[parent][1 + side] = node
        if depth >= max_depth or len(idx) == 1:
            continue
        tried = np.arange(width) if n_features >= width else np.sort(rng.choice(width, n_features, replace=False))
        flat = (bins[np.ix_(idx, tried)] + np.arange(len(tried)) * most).ravel()

        def left_of(v):  # sums left of each threshold of each feature
            return np.cumsum(np.bincount(flat, np.repeat(v[idx], len(tried)), len(tried) * most).reshape(-1, most), axis=1)

        left = left_of(w)
        both = left * (total - left)
        moved = sum((left_of(s[:, k]) - left * mean[k]) ** 2 for k in range(s.shape[1]))
        gain = np.divide(moved, both, out=np.zeros_like(both), where=both > 0)
        at, split = divmod(int(np.argmax(gain)), most)
        if gain[at, split] <= noise:
            continue
        feature = int(tried[at])
        goes = bins[idx, feature] <= split
        nodes[node][3], nodes[node][4] = feature, float(thresholds[feature][split])
        stack.append((idx[~goes], depth + 1, node, 1))
        stack.append((idx[goes], depth + 1, node, 0))
    return [tuple(n) for n in nodes]


def fit(train: DataFrame, layout: DataFrame, rows: int, features: str, target: str, classes: int, n_trees: int, max_depth: int,
        max_bins: int, n_features, seed: int, **columns) -> "CellForestModel | None":
    """``layout``: the ``rows`` rows of ``train`` in their canonical layout, in which the counts are drawn. ``classes``: 0 for a
    regression. ``n_features``: how many features a split tries, from the number of all."""
    first = train.select(F.col(features)).first()
    width = len(first[0]) if first else 0
    if not 0 < width <= MOST_FEATURES:
        return None
    x = train.select(vector_to_array(F.col(features)).alias("x"))
    laid = layout.select(vector_to_array(F.col(features)).alias("x"), F.col(target).cast("double").alias("y"))
    thresholds = bin_thresholds(x, laid, width, rows, max_bins, seed)
    k = max(classes, 1)
    most = MOST_SUMS // (n_trees * k)
    if most < 1 or math.prod(len(t) + 1 for t in thresholds) > 2**62:
        return None

    def occupied(batches):
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if len(seen) <= most:
                seen = np.unique(np.concatenate([seen, cell_codes(_matrix(batch.column(0)), thresholds)]))
        yield pa.RecordBatch.from_pydict({"cell": seen[:most + 1]})

    cells = np.sort([r["cell"] for r in x.mapInArrow(occupied, "cell long").distinct().limit(most + 1).collect()]).astype(np.int64)
    if len(cells) > most:
        return None
    n_cells = len(cells)

    def sums(batches):
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, part])
        w = None if classes else np.zeros((n_cells, n_trees))
        s = np.zeros((n_cells * k, n_trees))
        seen = 0
        for batch in batches:
            seen += batch.num_rows
            if not batch.num_rows:
                continue
            place = np.searchsorted(cells, cell_codes(_matrix(batch.column(0)), thresholds))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            if classes:
                place = place * k + y.astype(np.int64)
            for a in range(0, len(place), _DRAWN):
                # drawn row by row, so the size of the batches has no influence
                at, drawn = place[a:a + _DRAWN], bootstrap_counts(rng, min(_DRAWN, len(place) - a), n_trees)
                order = np.argsort(at, kind="stable")
                begins = np.flatnonzero(np.diff(at[order], prepend=-1))
                groups, drawn = at[order][begins], drawn[order].astype(np.float64)
                if classes:
                    s[groups] += np.add.reduceat(drawn, begins)
                else:
                    w[groups] += np.add.reduceat(drawn, begins)
                    drawn *= y[a:a + _DRAWN][order][:, None]
                    s[groups] += np.add.reduceat(drawn, begins)
        if seen:
            for a in range(0, n_trees, 16):
                mine = range(a, min(a + 16, n_trees))
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array(list(mine), pa.int32()), "part": pa.array([part] * len(mine), pa.int32()),
                    "w": pa.array([[] if w is None else w[:, t] for t in mine], pa.list_(pa.float64())),
                    "s": pa.array([s[:, t] for t in mine], pa.list_(pa.float64()))})

    tries = n_features(width)
    bins = cell_bins(cells, thresholds)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("part")
        s = np.sum(np.stack(pdf["s"].to_numpy()), axis=0).reshape(n_cells, k)
        w = s.sum(axis=1) if classes else np.sum(np.stack(pdf["w"].to_numpy()), axis=0)
        grown = grow_tree(bins, w, s, thresholds, max_depth, tries, np.random.default_rng([seed, tree, 1]))
        out = pd.DataFrame(grown, columns=["node", "left", "right", "feature", "threshold", "value"])
        out.insert(0, "tree", tree)
        return out

    parts = laid.mapInArrow(sums, "tree int, part int, w array<double>, s array<double>")
    nodes = parts.repartition(min(n_trees, 64), "tree").groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    if nodes.empty:  # a row or two, and no tree drew one
        return None
    model = CellForestModel(nodes.sort_values(["tree", "node"], ignore_index=True))
    model._set(featuresCol=features, classes=classes, **columns)
    return model


def _tables(nodes: pd.DataFrame) -> tuple[dict, list[np.ndarray]]:
    """The trees in one table (children by position in it), and the thresholds of each feature."""
    nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
    first = nodes.groupby("tree")["node"].transform("size").to_numpy()
    roots = np.flatnonzero(nodes["node"].to_numpy() == 0)
    start = np.repeat(roots, first[roots])
    arr = {c: nodes[c].to_numpy() for c in ("feature", "threshold")}
    arr |= {c: nodes[c].to_numpy() + start for c in ("left", "right")}
    inner = arr["feature"] >= 0
    thresholds = [np.unique(arr["threshold"][inner & (arr["feature"] == f)]) for f in range(int(arr["feature"].max()) + 1)]
    return arr | {"value": np.stack(nodes["value"].to_numpy()), "roots": roots}, thresholds


def forest_means(m: np.ndarray, arr: dict, thresholds: list[np.ndarray]) -> np.ndarray:
    """The mean over the trees of the values of the leaves that each row of ``m`` falls into."""
    bins = np.stack([np.searchsorted(t, m[:, f]) for f, t in enumerate(thresholds)], axis=1) if thresholds else np.zeros((len(m), 1), int)
    _, one, back = np.unique(bins, axis=0, return_index=True, return_inverse=True)
    x, total = m[one], np.zeros((len(one), arr["value"].shape[1]))
    rows = np.arange(len(x))
    for root in arr["roots"]:
        at = np.full(len(x), root)
        while (inner := arr["feature"][at] >= 0).any():
            below = x[rows, np.where(inner, arr["feature"][at], 0)] <= arr["threshold"][at]
            at = np.where(inner, np.where(below, arr["left"][at], arr["right"][at]), at)
        total += arr["value"][at]
    return (total / len(arr["roots"]))[np.ravel(back)]


class CellForestModel(Model, MLReadable, MLWritable):
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "predicted value or class index", TypeConverters.toString)
    rawPredictionCol = Param(Params._dummy(), "rawPredictionCol", "class votes summed over the trees", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "class probabilities", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for a regression", TypeConverters.toInt)

    def __init__(self, nodes: pd.DataFrame | None = None):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", rawPredictionCol="rawPrediction",
                         probabilityCol="probability", classes=0)
        self.nodes = nodes

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        arr, thresholds = _tables(self.nodes)
        bc = df.sparkSession.sparkContext.broadcast((arr, thresholds))

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def means(xs: pd.Series) -> pd.Series:
            if len(xs) == 0:
                return pd.Series([], dtype=object)
            return pd.Series(list(forest_means(np.stack(xs.to_numpy()).astype(float), *bc.value)))

        out = df.withColumn("__means", means(vector_to_array(F.col(g(self.featuresCol)))))
        if not g(self.classes):
            return out.withColumn(g(self.predictionCol), F.col("__means")[0]).drop("__means")
        trees = float(len(arr["roots"]))
        out = out.withColumns({
            g(self.rawPredictionCol): array_to_vector(F.transform("__means", lambda p: p * F.lit(trees))),
            g(self.probabilityCol): array_to_vector(F.col("__means")),
            g(self.predictionCol): (F.array_position("__means", F.array_max("__means")) - 1).cast("double")})
        return out.drop("__means")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: CellForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc)
        self.sparkSession.createDataFrame(self.instance.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CellForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        model = CellForestModel(self.sparkSession.read.parquet(f"{path}/data").toPandas())
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
