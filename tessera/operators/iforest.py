"""Isolation forest (M6) as a ``pyspark.ml`` Estimator / Model.

Algorithm: Liu, Ting & Zhou, "Isolation Forest", ICDM 2008. Defaults follow the
reference's library: 100 trees, psi = min(256, n) rows per tree drawn without
replacement, depth limit ceil(log2 psi), split feature uniform among the
features that are not constant in the node, threshold uniform in (min, max),
score s = 2^(-E[h(x)] / c(psi)), ``anomaly_score = 0.5 - s`` (higher = more
normal), anomaly when the score is negative.

Spark plan:
1. sample: rows are counted by a 64-bit hash of key and features (8 bytes and a
   count are shuffled, copies combined before), and the hash alone decides which
   contents, and how many of their copies, enter a pool of about 3*T*psi rows; the
   same data in any layout gives the same pool. Its contents are fetched by a
   broadcast of the chosen hashes (bounded by the pool), then every tree picks psi
   rows in hash order with ``row_number`` over the pool.
2. grow: ``groupBy("tree").applyInPandas`` - one task per tree builds the node
   table ``(tree, node, left, right, feature, threshold, size, depth)``.
3. score: the node table (<= T * (2 psi - 1) rows, independent of n) is
   broadcast, and a pandas UDF walks all trees for a whole Arrow batch at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("size", T.LongType()), T.StructField("depth", T.IntegerType()),
])


def average_path_length(n: np.ndarray | float) -> np.ndarray:
    """c(n): expected path length of an unsuccessful BST search; c(<=1)=0, c(2)=1."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out


def grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Node rows ``(node, left, right, feature, threshold, size, depth)`` of one tree."""
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, 0)]
    while stack:
        idx, depth, parent, side = stack.pop()
        node_id = len(nodes)
        nodes.append([node_id, -1, -1, -1, 0.0, len(idx), depth])
        if parent >= 0:
            nodes[parent][1 + side] = node_id
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        varying = np.flatnonzero(hi > lo)
        if varying.size == 0:
            continue
        f = int(varying[rng.integers(varying.size)])
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= thr
        nodes[node_id][3], nodes[node_id][4] = f, thr
        # push right first so the left child gets the next id
        stack.append((idx[~go_left], depth + 1, node_id, 1))
        stack.append((idx[go_left], depth + 1, node_id, 0))
    return [tuple(n) for n in nodes]


def _forest_arrays(nodes: pd.DataFrame, n_trees: int) -> dict:
    width = int(nodes["node"].max()) + 1
    shape = (n_trees, width)
    arr = {k: np.full(shape, -1, dtype=np.int64) for k in ("left", "right", "feature")}
    arr["threshold"] = np.zeros(shape)
    arr["leaf_len"] = np.zeros(shape)
    t, n = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
    for k in ("left", "right", "feature"):
        arr[k][t, n] = nodes[k].to_numpy()
    arr["threshold"][t, n] = nodes["threshold"].to_numpy()
    arr["leaf_len"][t, n] = nodes["depth"].to_numpy() + average_path_length(nodes["size"].to_numpy())
    return arr


def path_lengths(x: np.ndarray, arr: dict, max_depth: int) -> np.ndarray:
    """Mean path length over all trees for each row of ``x`` (vectorised per tree)."""
    n_trees = arr["left"].shape[0]
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in range(n_trees):
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(max_depth + 1):
            feat = arr["feature"][t, node]
            inner = feat >= 0
            if not inner.any():
                break
            f = np.where(inner, feat, 0)
            val = x[rows, f]
            nxt = np.where(val <= arr["threshold"][t, node], arr["left"][t, node], arr["right"][t, node])
            node = np.where(inner, nxt, node)
        total += arr["leaf_len"][t, node]
    return total / n_trees


class _HasIForestParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector column", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "stable row key used for sampling", TypeConverters.toString)
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxSamples = Param(Params._dummy(), "maxSamples", "rows per tree (capped at n)", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)
    scoreCol = Param(Params._dummy(), "scoreCol", "decision score column", TypeConverters.toString)
    anomalyCol = Param(Params._dummy(), "anomalyCol", "boolean anomaly column", TypeConverters.toString)


class IsolationForest(Estimator, _HasIForestParams):
    def __init__(self, featuresCol="features", keyCol="row_key", numTrees=100, maxSamples=256, seed=42,
                 scoreCol="anomaly_score", anomalyCol="is_anomaly"):
        super().__init__()
        self._set(featuresCol=featuresCol, keyCol=keyCol, numTrees=numTrees, maxSamples=maxSamples, seed=seed,
                  scoreCol=scoreCol, anomalyCol=anomalyCol)

    def _fit(self, df: DataFrame) -> "IsolationForestModel":
        g = self.getOrDefault
        n_trees, seed, key = g(self.numTrees), g(self.seed), g(self.keyCol)
        data = df.select(vector_to_array(F.col(g(self.featuresCol))).alias("_x"), F.col(key).alias("_key"))
        # rounded: sums over another layout may move a scaled feature by its last bits
        rounded = F.transform("_x", lambda v: F.round(v, 6))
        data = data.select("_x", F.xxhash64("_key", rounded).alias("_id"))
        counts = data.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).persist(StorageLevel.MEMORY_AND_DISK)
        n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        if n == 0:
            raise ValueError("Dataset is empty.")
        psi = min(g(self.maxSamples), n)
        max_depth = int(math.ceil(math.log2(max(psi, 2))))
        # 1. pool: of m copies of a content floor(m * frac) enter, and one more if its hash falls into the rest
        frac = min(1.0, 3.0 * n_trees * psi / n)
        spread = float(1 << 30)
        place = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(spread)
        expected = F.col("_n") * F.lit(frac)
        chosen = (counts.withColumn("_m", (F.floor(expected) + F.when(place < expected - F.floor(expected), 1).otherwise(0)).cast("long"))
                  .where(F.col("_m") > 0).select("_id", "_m"))
        contents = data.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.first("_x").alias("_x"), F.first("_m").alias("_m"))
        pool = (contents.select("_x", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))).alias("_copy"), "_id")
                .select("_x", F.xxhash64("_id", "_copy").alias("_pid")).persist(StorageLevel.MEMORY_AND_DISK))
        m = pool.count()
        counts.unpersist()
        p_tree = min(1.0, 2.0 * psi / max(m, 1))
        thresh = int(p_tree * 1_000_000)
        trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
        if p_tree < 1.0:
            trees = F.filter(trees, lambda t: F.pmod(F.xxhash64(F.col("_pid"), t, F.lit(seed)), F.lit(1_000_000))
                             < F.lit(thresh))
        picks = (pool.select("_pid", "_x", F.explode(trees).alias("tree"))
                 .withColumn("_h", F.xxhash64("_pid", "tree", F.lit(seed + 1)))
                 .withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy("_h", "_pid")))
                 .where(F.col("_r") <= psi).select("tree", "_x", "_r"))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            x = np.stack(pdf.sort_values("_r")["_x"].to_numpy()).astype(float)
            rng = np.random.default_rng([seed, tree])
            rows = grow_tree(x, rng, max_depth)
            out = pd.DataFrame(rows, columns=["node", "left", "right", "feature", "threshold", "size", "depth"])
            out.insert(0, "tree", tree)
            return out.astype({"tree": "int32", "node": "int32", "left": "int32", "right": "int32",
                               "feature": "int32", "size": "int64", "depth": "int32"})

        nodes = picks.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
        pool.unpersist()
        model = IsolationForestModel(nodes=nodes, psi=psi, maxDepth=max_depth)
        model._set(**{p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)})
        return model


class IsolationForestModel(Model, _HasIForestParams, MLReadable, MLWritable):
    psi = Param(Params._dummy(), "psi", "rows per tree actually used", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth limit", TypeConverters.toInt)

    def __init__(self, nodes: pd.DataFrame | None = None, psi: int = 256, maxDepth: int = 8):
        super().__init__()
        self._set(psi=psi, maxDepth=maxDepth)
        self._setDefault(featuresCol="features", keyCol="row_key", numTrees=100, maxSamples=256, seed=42,
                         scoreCol="anomaly_score", anomalyCol="is_anomaly")
        self.nodes = nodes

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        n_trees = int(self.nodes["tree"].max()) + 1
        arr = _forest_arrays(self.nodes, n_trees)
        bc = df.sparkSession.sparkContext.broadcast(arr)
        depth = g(self.maxDepth)
        c_psi = float(average_path_length(np.array([g(self.psi)]))[0]) or 1.0

        @F.pandas_udf(T.DoubleType())
        def score(xs: pd.Series) -> pd.Series:
            if len(xs) == 0:
                return pd.Series([], dtype=float)
            x = np.stack(xs.to_numpy()).astype(float)
            s = np.power(2.0, -path_lengths(x, bc.value, depth) / c_psi)
            return pd.Series(0.5 - s)

        out = df.withColumn(g(self.scoreCol), score(vector_to_array(F.col(g(self.featuresCol)))))
        return out.withColumn(g(self.anomalyCol), F.col(g(self.scoreCol)) < 0)

    def write(self) -> MLWriter:
        return _IForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _IForestReader(cls)


class _IForestWriter(MLWriter):
    def __init__(self, instance: IsolationForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc)
        spark = self.sparkSession
        spark.createDataFrame(self.instance.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite") \
            .parquet(f"{path}/data")


class _IForestReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> IsolationForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        nodes = self.sparkSession.read.parquet(f"{path}/data").toPandas()
        model = IsolationForestModel(nodes=nodes)
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
