"""End-to-end task plans (M9): ``run_task(df, task, model_name, target, ...)``.

Supervised: guards -> drop null targets (P1) -> row key -> exact split (R1) ->
preprocessor fitted on train only (F1-F5) -> model fit -> predict on test ->
metrics. Unsupervised: preprocessor and model fitted on all rows and columns.

Returns ``TaskResult(model, results, report, plot)``: the fitted ``PipelineModel``,
the results DataFrame (distributed), the report dict (small scalars) and the plot
data as small aggregate DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import as_text, is_missing, is_numeric
from tessera.operators import metrics
from tessera.operators import models as M
from tessera.operators.prep import fit_preprocessor, split_roles
from tessera.operators.split import exact_split_cached, with_row_key
from tessera.operators.stages import CopyColumn

IS_TEST = "__is_test"
#: Observed pairs of classes that a report may bring to the driver, for each class of ``dense_classes``.
DENSE_PAIRS = 50
#: Columns that a run adds to the user's table while it works.
INTERNAL = {M.ROW_KEY, IS_TEST, M.FEATURES, M.LABEL, M.PREDICTION, M.Y, "__y_text", "__y_pred", "__split_hash"}


class _Lazy:
    def __init__(self, fn):
        self.fn = fn


class Plot(dict):
    """Plot payload; entries built by a function are computed on first access,
    so a task never runs plot jobs nobody reads."""

    def __getitem__(self, key):
        value = super().__getitem__(key)
        if isinstance(value, _Lazy):
            value = value.fn()
            super().__setitem__(key, value)
        return value

    def get(self, key, default=None):
        return self[key] if key in self else default

    def values(self):
        return [self[k] for k in self]

    def items(self):
        return [(k, self[k]) for k in self]

    def __or__(self, other):
        return dict(self.items()) | dict(other)

    def copy(self):
        return dict(self.items())


@dataclass
class TaskResult:
    model: PipelineModel
    results: DataFrame
    report: dict
    plot: dict = field(default_factory=Plot)
    unpersist: list = field(default_factory=list)

    def release(self) -> None:
        for d in self.unpersist:
            d.unpersist()
        self.unpersist.clear()


def _c(name: str):
    return F.col(f"`{name}`")


def _check_input(df: DataFrame | None) -> None:
    if df is None or df.isEmpty():
        raise ValueError(M.EMPTY)
    taken = {c.lower() for c in df.columns} & INTERNAL
    if taken:
        raise ValueError(f"Column '{sorted(taken)[0]}' has a name that the engine uses itself; rename it.")


def _with_results(df: DataFrame, user_cols: list[str], results: list[str]) -> DataFrame:
    """The user's columns and the results; a result replaces a user's column of its name."""
    names = {r.lower() for r in results}
    return df.select(*[_c(c) for c in user_cols if c.lower() not in names], *[_c(r) for r in results])


def run_task(df: DataFrame, task: str, model_name: str, target: str | None = None, test_size: float = 0.2,
             random_state: int = 42, params: dict | None = None, key_cols: list[str] | None = None,
             exclude: list[str] | tuple = ()) -> TaskResult:
    """Run one of the five tasks end to end (the reference's ``run_task``).

    ``random_state`` seeds the split and every model (one seed for all).
    ``key_cols`` name a unique key (otherwise a content hash is used);
    ``exclude`` removes columns from the features (ids, for example).
    """
    p = dict(M.DEFAULTS)
    p.update(params or {})
    report: dict = {"task": task, "model": model_name}
    _check_input(df)
    if task in ("Classification", "Regression"):
        if not target:
            raise ValueError(M.NO_TARGET)
        if target not in df.columns:
            raise ValueError(M.TARGET_NOT_FOUND)
        M.check_model(task, model_name)
        return _supervised(df, task, model_name, target, test_size, random_state, p, key_cols, exclude, report)
    M.check_model(task, model_name)
    return _unsupervised(df, task, model_name, random_state, p, key_cols, exclude, report)


def with_target(df: DataFrame, target: str) -> DataFrame:
    """The rows whose target is there (NaN is missing too)."""
    return df.where(~is_missing(_c(target), df.schema[target].dataType))


def _supervised(df, task, model_name, target, test_size, seed, p, key_cols, exclude, report) -> TaskResult:
    target_type = df.schema[target].dataType
    df2 = with_row_key(with_target(df, target), key_cols, M.ROW_KEY)
    skip = {target, M.ROW_KEY, *exclude}
    num_cols, cat_cols = split_roles(df2, [c for c in df2.columns if c not in skip])
    # only the key, the target and the features are cached for the fit passes
    df2 = df2.select(M.ROW_KEY, _c(target), *[_c(c) for c in num_cols + cat_cols])
    split, cached = exact_split_cached(df2, test_size, seed, M.ROW_KEY, IS_TEST)
    train = split.where(~F.col(IS_TEST))
    test = split.where(F.col(IS_TEST))
    prep, info = fit_preprocessor(train, num_cols, cat_cols, M.FEATURES, p["driver_levels"])
    held = [cached]
    if task == "Classification":
        ytxt = as_text(_c(target), target_type)
        if isinstance(target_type, (T.FloatType, T.DoubleType, T.DecimalType)) and not train.where(_c(target) != F.floor(_c(target))).isEmpty():
            raise ValueError("Unknown label type: continuous. The classification target holds fractional numbers.")
        # the label list is the model's own: every classifier holds it on the driver, class by class
        seen = train.select(ytxt.alias("__y_text")).distinct().toPandas()["__y_text"].tolist()
        labels = metrics.label_order(seen, is_numeric(target_type))
        if model_name == "Logistic Regression" and len(labels) < 2:
            raise ValueError("This solver needs samples of at least 2 classes in the data, but the data contains "
                             f"only one class: {labels[0]!r}")
        # train labels only: "keep" would add an unknown class to the metadata (3 classes for a binary task)
        indexer = StringIndexerModel.from_labels(labels, inputCol="__y_text", outputCol=M.LABEL,
                                                 handleInvalid="error")
        train_feat = M.persist(indexer.transform(prep.transform(train.withColumn("__y_text", ytxt)))
                               .select(M.ROW_KEY, M.FEATURES, M.LABEL))
        held.append(train_feat)
        fitted = M.fit_classifier(model_name, train_feat, info.rows, seed, p)
        to_text = IndexToString(inputCol=M.PREDICTION, outputCol="__y_pred", labels=labels)
        model = PipelineModel([prep, fitted, to_text, CopyColumn(inputCol="__y_pred")])
        results = (model.transform(test)
                   .select(F.col(M.ROW_KEY).alias("row_key"), ytxt.alias("y_true"), F.col("y_pred")))
        most = int(p["dense_classes"])
        long = M.persist(metrics.confusion_long(results))
        held.append(long)
        conf = long.limit(most * DENSE_PAIRS + 1).toPandas()
        numeric = is_numeric(target_type)
        if len(conf) <= most * DENSE_PAIRS and len(set(conf["y_true"]) | set(conf["y_pred"])) <= most:
            rep = metrics.classification_report(list(conf.itertuples(index=False, name=None)), numeric)
            report.update(rep)
            cm, all_labels = rep["confusion_matrix"], rep["class_labels"]
            plot = Plot(type="confusion_matrix", cm=cm, labels=all_labels,
                        data=_Lazy(lambda: metrics.confusion_dense(results, all_labels)))
        else:  # neither matrix nor labels pass through the driver: the plot data are the cells that are not zero
            row = metrics.metrics_of_confusion(long).first()
            report.update({"accuracy": float(row["accuracy"]), "f1_weighted": float(row["f1_weighted"]),
                           "confusion_matrix": None, "class_labels": None})
            plot = Plot(type="confusion_matrix", cm=None, labels=None,
                        data=_Lazy(lambda: metrics.confusion_sparse(long, numeric)))
    else:
        if not is_numeric(target_type):
            raise ValueError("Regression target must be numeric.")
        y = _c(target).cast("double")
        ystats = train.agg(F.stddev_pop(y).alias("sd")).first()
        train_feat = M.persist(prep.transform(train).select(M.ROW_KEY, M.FEATURES, y.alias(M.Y)))
        held.append(train_feat)
        fitted = M.fit_regressor(model_name, train_feat, info.rows, float(ystats["sd"] or 0.0), seed, p,
                                 info.width)
        model = PipelineModel([prep, fitted, CopyColumn(inputCol=M.PREDICTION)])
        results = model.transform(test).select(F.col(M.ROW_KEY).alias("row_key"), y.alias("y_true"), F.col("y_pred"))
        row = metrics.regression_metrics(results).first()
        report.update({"rmse": float(row["rmse"]), "r2": float(row["r2"])})
        plot = Plot(type="pred_vs_actual", range=_Lazy(lambda: metrics.axis_range(results)),
                    data=_Lazy(lambda: metrics.grid_counts(results, "y_true", "y_pred")),
                    points=_Lazy(lambda: metrics.scatter_sample(results, "y_true", "y_pred", ["row_key"], seed=seed)))
    return TaskResult(model, results, report, plot, held)


def _unsupervised(df, task, model_name, seed, p, key_cols, exclude, report) -> TaskResult:
    # the input (all columns: the results keep them) is cached once; the statistics passes read it,
    # the fits read a compact cached (row_key, features) table, and the results apply the fitted
    # pipeline to the cached input
    keyed = M.persist(with_row_key(df, key_cols, M.ROW_KEY))
    held = [keyed]
    user_cols = [c for c in df.columns]
    skip = {M.ROW_KEY, *exclude}
    num_cols, cat_cols = split_roles(keyed, [c for c in keyed.columns if c not in skip])
    prep, info = fit_preprocessor(keyed, num_cols, cat_cols, M.FEATURES, p["driver_levels"])
    feats = M.persist(prep.transform(keyed).select(M.ROW_KEY, M.FEATURES))
    held.append(feats)
    width = info.width
    if task == "Clustering":
        if info.rows < int(p["k"]):
            raise ValueError(f"n_samples={info.rows} should be >= n_clusters={int(p['k'])}.")
        km = M.fit_kmeans(feats, seed, p, info.mean_variance, info.rows)
        model = PipelineModel([prep, km])
        out = model.transform(keyed)
        results = _with_results(out, user_cols, ["cluster"])
        sizes = metrics.cluster_sizes(results).collect()
        report.update({"k": int(p["k"]), "cluster_counts": {int(r["cluster"]): int(r["n"]) for r in sizes}})
        plot = Plot(type="scatter2d")
        if width >= 2 and info.rows >= 2:
            def view():
                pca, _ = M.fit_pca(feats, info.feature_means, 2, width, int(p["matrix_features"]))
                return pca.transform(out.select(M.ROW_KEY, M.FEATURES, "cluster"))
            plot["data"] = _Lazy(lambda: metrics.grid_counts(view(), "pc1", "pc2", group="cluster"))
            plot["points"] = _Lazy(lambda: metrics.scatter_sample(view(), "pc1", "pc2", [M.ROW_KEY], group="cluster", seed=seed))
        return TaskResult(model, results, report, plot, held)
    if task == "Anomaly Detection":
        forest = M.fit_iforest(feats, seed, p)
        model = PipelineModel([prep, forest])
        results = _with_results(model.transform(keyed), user_cols, ["is_anomaly", "anomaly_score"])
        results = M.persist(results)
        held.append(results)
        report.update({"anomalies": int(metrics.anomaly_count(results).first()["anomalies"])})
        plot = Plot(type="hist", data=_Lazy(lambda: metrics.histogram(results, "anomaly_score", 30)))
        return TaskResult(model, results, report, plot, held)
    # Dimensionality Reduction
    k = int(p["components"])
    if width < k:
        raise ValueError(f"PCA needs at least {k} features after encoding; found {width}.")
    if info.rows < k:
        raise ValueError(f"n_components={k} must be between 0 and min(n_samples, n_features)="
                         f"{min(info.rows, width)}")
    pca, evr = M.fit_pca(feats, info.feature_means, k, width, int(p["matrix_features"]))
    model = PipelineModel([prep, pca])
    out = model.transform(keyed)
    results = _with_results(out, user_cols, [f"pc{j + 1}" for j in range(k)])
    report.update({"components": k, "explained_variance_ratio": evr})
    plot = Plot(type="scatter2d")
    if k >= 2:
        plot["data"] = _Lazy(lambda: metrics.grid_counts(results, "pc1", "pc2"))
        plot["points"] = _Lazy(lambda: metrics.scatter_sample(out, "pc1", "pc2", [M.ROW_KEY], seed=seed))
    return TaskResult(model, results, report, plot, held)
