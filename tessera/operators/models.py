"""Model factories (M1-M5, M7) mapped onto ``pyspark.ml`` with the reference's objectives.

* Logistic regression (C=1, L2, free intercept): ``regParam = 1/n_train``,
  no internal standardisation (the inputs are already z-scored).
* Ridge (alpha=1): normal-equation ``LinearRegression`` with
  ``regParam = alpha * std_pop(y_train) / n_train`` (Spark scales the penalty by
  the label's std); constant labels short-circuit to the mean.
  Above 4,096 features the library's normal equations end, and L-BFGS takes
  over (there the scale is the sample standard deviation of y).
* Random forests: the reference grows unlimited-depth trees with exact splits;
  MLlib ends at depth 30, the default here, and bins splits (32 by default).
  Same algorithm, comparable (not equal) trees. Forests of more than
  ``library_trees`` trees are grown from sums by cell (``forest``), as the library
  keeps a count and walks a map entry for each row and tree; where the bins have
  too many cells for that, they are the library's too.
* K-means: k=3, k-means|| init, clusters renumbered by (size desc, centre).
* PCA: 2 components, centred scores, sign fixed so that each component's
  largest-magnitude loading is positive. Beyond 4,096 features no covariance
  matrix is formed (``widepca``).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import forest, widepca
from tessera.operators.iforest import IsolationForest
from tessera.operators.stages import IndexMap, PCScores
from tessera.operators.stats import DRIVER_LEVELS

# The reference's task names and the model names offered per task.
TASKS = ["Classification", "Regression", "Clustering", "Anomaly Detection", "Dimensionality Reduction"]
MODELS = {
    "Classification": ["Logistic Regression", "Random Forest Classifier"],
    "Regression": ["Ridge Regression", "Random Forest Regressor"],
    "Clustering": ["KMeans"],
    "Anomaly Detection": ["Isolation Forest"],
    "Dimensionality Reduction": ["PCA"],
}
# The reference's error text for an unknown model, per task.
UNKNOWN_MODEL = {
    "Classification": "Unknown classification model",
    "Regression": "Unknown regression model",
    "Clustering": "Unknown clustering model",
    "Anomaly Detection": "Unknown anomaly model",
    "Dimensionality Reduction": "Unknown reduction model",
}

# The error texts of the reference's guards.
EMPTY, NO_TARGET, TARGET_NOT_FOUND, UNKNOWN_TASK = (
    "Dataset is empty.", "Target column is required.", "Target column not found in dataset.", "Unknown task")

# Internal column names; the double underscore keeps them clear of user columns
# (a table may well have a column called "label", "features" or "prediction").
FEATURES, LABEL, PREDICTION, Y, ROW_KEY = "__features", "__label", "__prediction", "__y", "__row_key"
NORMAL_FEATURES = 4096  # the library's limit for normal equations
MATRIX_FEATURES = 4096  # PCA holds a covariance matrix on the driver up to here (128 MB)
_EXTRA = {"rawPredictionCol": "__raw", "probabilityCol": "__prob"}

DEFAULTS = {
    "logreg_max_iter": 2000, "logreg_tol": 1e-6,
    "ridge_alpha": 1.0,
    "num_trees": 300, "max_depth": 30, "max_bins": 32, "forest_memory_mb": 1024, "library_trees": 64,
    "k": 3, "kmeans_max_iter": 300, "kmeans_tol": 1e-4,  # relative, as in the reference's library
    "iforest_trees": 100, "iforest_max_samples": 256,
    "components": 2, "matrix_features": MATRIX_FEATURES,
    "rows_per_partition": 500_000, "least_partitions": 8,
    "driver_levels": DRIVER_LEVELS, "dense_classes": 2_000,
}


def check_model(task: str, model_name: str) -> None:
    """The reference's dispatch errors."""
    if task not in MODELS:
        raise ValueError(UNKNOWN_TASK)
    if model_name not in MODELS[task]:
        raise ValueError(UNKNOWN_MODEL[task])


def canonical_layout(df: DataFrame, n_partitions: int, key: str = ROW_KEY) -> DataFrame:
    """Layout-independent input for seeded fits: hash-partition by key, sort within.

    MLlib's seeded algorithms draw per partition, so the same data in another
    layout gives another forest or clustering; this fixes the layout. A key that
    holds more than half a partition's share of the rows would make one task hot:
    its rows are counted by content (copies combine before the shuffle) and dealt
    out again copy by copy, so where they lay before has no influence.
    """
    others = [c for c in df.columns if c != key]
    plain = [F.unwrap_udt(F.col(c)) if c == FEATURES else F.col(c) for c in others]
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n"), F.max("n")).first()
    share = max(2.0, 0.5 * (total[0] or 0) / n_partitions)
    # at most 2 * n_partitions keys hold half a share each
    hot = [] if (total[1] or 0) < share else [r[0] for r in counts.where(F.col("n") >= share).select(key).toLocalIterator()]
    if not hot:
        return df.repartition(n_partitions, key).sortWithinPartitions(key, F.xxhash64(*plain))
    copies = (df.where(F.col(key).isin(hot)).withColumn("__content", F.xxhash64(*plain)).groupBy(key, "__content")
              .agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in others]))
    dealt = copies.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    rest = df.where(~F.col(key).isin(hot)).withColumn("__content", F.xxhash64(*plain)).withColumn("__salt", F.lit(0).cast("long"))
    out = rest.unionByName(dealt.drop("__n"))
    return out.repartition(n_partitions, key, "__salt").sortWithinPartitions(key, "__content").drop("__content", "__salt")


def fit_partitions(rows: int, params: dict) -> int:
    """From the number of rows alone: the same data gives the same model under any cluster settings."""
    return max(int(params["least_partitions"]), -(-rows // int(params["rows_per_partition"])))


def fit_classifier(model_name: str, train: DataFrame, n_train: int, seed: int, params: dict):
    if model_name == "Logistic Regression":
        est = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, **_EXTRA,
                                 regParam=1.0 / n_train, elasticNetParam=0.0, standardization=False,
                                 maxIter=params["logreg_max_iter"], tol=params["logreg_tol"], family="auto")
        return est.fit(train)
    layout = canonical_layout(train, fit_partitions(n_train, params))
    if params["num_trees"] > params["library_trees"] and n_train:
        classes = int(train.agg(F.max(LABEL)).first()[0]) + 1
        # the library's "sqrt"
        model = _cell_forest(train, layout, n_train, LABEL, classes, lambda width: math.ceil(width ** 0.5), seed, params, **_EXTRA)
        if model is not None:
            return model
    est = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, **_EXTRA,
                                 numTrees=params["num_trees"], maxDepth=params["max_depth"],
                                 maxBins=params["max_bins"], featureSubsetStrategy="sqrt", impurity="gini",
                                 seed=seed, maxMemoryInMB=params["forest_memory_mb"])
    return est.fit(layout)


def _cell_forest(train, layout, n_train, target, classes, n_features, seed, params, **columns):
    return forest.fit(train, layout, n_train, FEATURES, target, classes, params["num_trees"], params["max_depth"], params["max_bins"],
                      n_features, seed, predictionCol=PREDICTION, **columns)


def fit_regressor(model_name: str, train: DataFrame, n_train: int, y_std: float, seed: int, params: dict, width: int = 1):
    if model_name == "Ridge Regression":
        alpha = params["ridge_alpha"]
        if y_std == 0.0:
            # constant label: zero coefficients, intercept = that constant
            est = LinearRegression(featuresCol=FEATURES, labelCol=Y, predictionCol=PREDICTION, regParam=0.0,
                                   solver="normal",
                                   standardization=False)
            return est.fit(train)
        if width > NORMAL_FEATURES:
            sample_std = y_std * (n_train / (n_train - 1)) ** 0.5
            est = LinearRegression(featuresCol=FEATURES, labelCol=Y, predictionCol=PREDICTION,
                                   regParam=alpha * sample_std / n_train, elasticNetParam=0.0, standardization=False,
                                   solver="l-bfgs", fitIntercept=True, maxIter=2000, tol=1e-12)
            return est.fit(train)
        est = LinearRegression(featuresCol=FEATURES, labelCol=Y, predictionCol=PREDICTION,
                               regParam=alpha * y_std / n_train, elasticNetParam=0.0, standardization=False,
                               solver="normal", fitIntercept=True)
        return est.fit(train)
    layout = canonical_layout(train, fit_partitions(n_train, params))
    if params["num_trees"] > params["library_trees"] and n_train:
        model = _cell_forest(train, layout, n_train, Y, 0, lambda width: width, seed, params)
        if model is not None:
            return model
    est = RandomForestRegressor(featuresCol=FEATURES, labelCol=Y, predictionCol=PREDICTION,
                                numTrees=params["num_trees"], maxDepth=params["max_depth"],
                                maxBins=params["max_bins"], featureSubsetStrategy="all", impurity="variance",
                                seed=seed, maxMemoryInMB=params["forest_memory_mb"])
    return est.fit(layout)


def fit_kmeans(feats: DataFrame, seed: int, params: dict, mean_variance: float = 1.0,
               rows: int = 0) -> PipelineModel:
    """KMeans + deterministic renumbering (largest cluster first, then by centre).

    The reference's tolerance is relative: stop when the summed squared centre
    shift is below ``tol * mean feature variance``; Spark stops when every centre
    moves less than an absolute distance, so that distance is the square root.
    """
    tol = max(params["kmeans_tol"] * mean_variance, 1e-30) ** 0.5
    km = KMeans(featuresCol=FEATURES, predictionCol="__km", k=params["k"], seed=seed,
                maxIter=params["kmeans_max_iter"], tol=tol, initMode="k-means||")
    model = km.fit(canonical_layout(feats, fit_partitions(rows, params)))
    sizes = list(model.summary.clusterSizes)
    centres = [tuple(float(v) for v in c) for c in model.clusterCenters()]
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], centres[i]))
    mapping = [0] * len(sizes)
    for new, old in enumerate(order):
        mapping[old] = new
    return PipelineModel([model, IndexMap(inputCol="__km", outputCol="cluster", mapping=mapping)])


def fit_iforest(feats: DataFrame, seed: int, params: dict):
    """No canonical layout here: the fit reads only its sample, which goes by content."""
    est = IsolationForest(featuresCol=FEATURES, keyCol=ROW_KEY, numTrees=params["iforest_trees"],
                          maxSamples=params["iforest_max_samples"], seed=seed)
    return est.fit(feats)


def fit_pca(feats: DataFrame, means: list[float] | None, k: int = 2, width: int | None = None,
            matrix_features: int = MATRIX_FEATURES) -> tuple[PipelineModel, list[float]]:
    """PCA + centring + sign rule, and the shares of the variance. Up to ``matrix_features`` features the library's, with the
    covariance on the driver, beyond ``widepca``. ``means`` and ``width`` are known from the preprocessor (None: summed up here)."""
    if width is None and means is None:
        means = feats.select(Summarizer.mean(F.col(FEATURES)).alias("m")).first()["m"].toArray().tolist()
    width = len(means) if width is None else width
    if width > matrix_features:
        return _fit_wide_pca(feats, k, width)
    if means is None:
        means = feats.select(Summarizer.mean(F.col(FEATURES)).alias("m")).first()["m"].toArray().tolist()
    model = PCA(k=k, inputCol=FEATURES, outputCol="__pca_raw").fit(feats)
    pc = model.pc.toArray()  # p x k
    mean = np.asarray(means)
    signs, offsets = [], []
    for j in range(k):
        v = pc[:, j]
        mag = np.abs(v)
        # first loading whose magnitude ties the largest (within rounding) is made positive
        lead = int(np.flatnonzero(mag >= mag.max() * (1.0 - 1e-9))[0])
        s = 1.0 if v[lead] >= 0 else -1.0
        signs.append(s)
        offsets.append(float(mean @ v))
    scores = PCScores(inputCol="__pca_raw", outputCols=[f"pc{j + 1}" for j in range(k)], offsets=offsets, signs=signs)
    return PipelineModel([model, scores]), [float(v) for v in model.explainedVariance.toArray()]


def _fit_wide_pca(feats: DataFrame, k: int, width: int) -> tuple[PipelineModel, list[float]]:
    loadings, _, shares, centre = widepca.principal_components(feats, FEATURES, k)
    signs = [widepca.leading_sign(loadings, f"v{j}") for j in range(k)]
    loadings = loadings.select("i", *[(F.lit(s) * F.col(f"v{j}")).alias(f"v{j}") for j, s in enumerate(signs)])
    offsets = [float(s * c) for s, c in zip(signs, centre)]
    return PipelineModel([widepca.Projection(FEATURES, [f"pc{j + 1}" for j in range(k)], offsets, width, loadings)]), shares


def persist(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)
