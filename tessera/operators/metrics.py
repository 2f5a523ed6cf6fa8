"""Evaluation and plot aggregates (A8-A18) as DataFrames.

Inputs are distributed prediction tables; every function returns a small
aggregate DataFrame (bounded by the number of classes, bins or metrics), so only
summaries ever reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import equal_width_bin, key_text, num_value
from tessera.operators.dictionary import ranked


def _c(name: str):
    return F.col(f"`{name}`")


def label_order(values: list[str], numeric: bool) -> list[str]:
    """Class order of the reference's library: natural order of the target type."""
    if numeric:
        return sorted(values, key=lambda v: (float(v), v))
    return sorted(values)


def class_labels(df: DataFrame, col: str) -> DataFrame:
    """Distinct labels in text order."""
    return df.select(_c(col).alias("label")).where(F.col("label").isNotNull()).distinct().orderBy("label")


def confusion_long(pred: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """A10, long form: ``(y_true, y_pred, n)`` over the observed pairs."""
    return pred.groupBy(_c(y_true).alias("y_true"), _c(y_pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_dense(pred: DataFrame, labels: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """A10, dense form over a given label list, zeros included; the grid is generated by the executors."""
    names = pred.sparkSession.createDataFrame(list(enumerate(labels)), "k int, label string")
    grid = (names.select(F.col("k").alias("i"), F.col("label").alias("y_true"),
                         F.explode(F.sequence(F.lit(0), F.lit(len(labels) - 1))).alias("j"))
            .join(names.select(F.col("k").alias("j"), F.col("label").alias("y_pred")), "j"))
    return (grid.join(confusion_long(pred, y_true, y_pred), ["y_true", "y_pred"], "left")
            .select("i", "j", "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def label_ranks(long: DataFrame, numeric: bool) -> DataFrame:
    """``(label, idx)``: the labels of a long confusion table in class order, numbered from 0 without a driver
    list or a single-task sort."""
    label = F.col("label")
    value = F.struct(label.cast("double").alias("v"), label) if numeric else F.struct(label)
    labels = long.select(F.explode(F.array("y_true", "y_pred")).alias("label")).where(label.isNotNull()).distinct()
    found = ranked(labels.select(F.lit(0).alias("position"), F.lit("label").alias("column"), value.alias("value")))
    return found.select("value.label", "idx")


def confusion_sparse(long: DataFrame, numeric: bool) -> DataFrame:
    """A10 for any number of classes: ``(i, j, y_true, y_pred, n)`` of the cells that are not zero, with the
    ranks of their labels. ``long`` is a table of ``confusion_long``; pairs with a null label are left out."""
    ranks = label_ranks(long, numeric)
    rows, cols = (ranks.select(F.col("label").alias(name), F.col("idx").alias(at)) for name, at in (("y_true", "i"), ("y_pred", "j")))
    return long.join(rows, "y_true").join(cols, "y_pred").select("i", "j", "y_true", "y_pred", "n")


def classification_metrics(pred: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """A11 + A12: one row ``(n, accuracy, f1_weighted)``, see ``metrics_of_confusion``."""
    return metrics_of_confusion(confusion_long(pred, y_true, y_pred))


def metrics_of_confusion(long: DataFrame) -> DataFrame:
    """A11 + A12 of a long confusion table: one row ``(n, accuracy, f1_weighted)``.

    Weighted F1 over the union of true and predicted labels; a label that is
    never predicted has precision 0 and F1 0, a label that is only predicted has
    support 0 and weight 0.
    """
    tp = long.where(F.col("y_true") == F.col("y_pred")).select(F.col("y_true").alias("label"), F.col("n").alias("tp"))
    support = long.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"))
    predicted = long.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    per = (support.join(predicted, "label", "full").join(tp, "label", "left")
           .select("label", F.coalesce("support", F.lit(0)).alias("support"),
                   F.coalesce("predicted", F.lit(0)).alias("predicted"), F.coalesce("tp", F.lit(0)).alias("tp")))
    f1 = F.when(F.col("support") + F.col("predicted") == 0, F.lit(0.0)).otherwise(
        2.0 * F.col("tp") / (F.col("support") + F.col("predicted")))
    return per.agg(F.sum("support").alias("n"),
                   (F.sum("tp") / F.sum("support")).alias("accuracy"),
                   (F.sum(F.col("support") * f1) / F.sum("support")).alias("f1_weighted"))


def classification_report(conf_rows: list[tuple[str, str, int]], numeric_labels: bool) -> dict:
    """Accuracy, weighted F1, label list and dense matrix from the (small) long
    confusion table, so a task needs a single aggregate job for all of them."""
    labels = label_order(sorted({t for t, _, _ in conf_rows} | {p for _, p, _ in conf_rows}), numeric_labels)
    pos = {lab: i for i, lab in enumerate(labels)}
    cm = [[0] * len(labels) for _ in labels]
    for t, p, n in conf_rows:
        cm[pos[t]][pos[p]] += int(n)
    total = sum(map(sum, cm))
    support = [sum(row) for row in cm]
    predicted = [sum(cm[i][j] for i in range(len(labels))) for j in range(len(labels))]
    tp = [cm[i][i] for i in range(len(labels))]
    f1 = [0.0 if support[i] + predicted[i] == 0 else 2.0 * tp[i] / (support[i] + predicted[i])
          for i in range(len(labels))]
    return {"accuracy": sum(tp) / total if total else 0.0,
            "f1_weighted": sum(s * f for s, f in zip(support, f1)) / total if total else 0.0,
            "confusion_matrix": cm, "class_labels": labels}


def regression_metrics(pred: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """A13 + A14 (+F7): one row ``(n, mse, rmse, r2)``; constant truth -> R2 1 if exact else 0."""
    y, p = _c(y_true).cast("double"), _c(y_pred).cast("double")
    agg = pred.agg(F.count(F.lit(1)).alias("n"), F.avg((y - p) * (y - p)).alias("mse"),
                   F.sum((y - p) * (y - p)).alias("ss_res"), (F.var_pop(y) * F.count(y)).alias("ss_tot"))
    r2 = (F.when(F.col("ss_tot") == 0, F.when(F.col("ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1.0 - F.col("ss_res") / F.col("ss_tot")))
    return agg.select("n", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def axis_range(pred: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One common ``(lo, hi)`` over truth and prediction."""
    y, p = num_value(_c(y_true)), num_value(_c(y_pred))
    return pred.agg(F.least(F.min(y), F.min(p)).alias("lo"), F.greatest(F.max(y), F.max(p)).alias("hi"))


def value_range(df: DataFrame, cols: list[str]) -> list[tuple[float | None, float | None]]:
    """Min and max of each column, NaN left out (one tiny aggregate, scalars to the driver)."""
    aggs = []
    for c in cols:
        aggs += [F.min(num_value(_c(c))), F.max(num_value(_c(c)))]
    r = df.agg(*aggs).first()
    return [(r[2 * i], r[2 * i + 1]) for i in range(len(cols))]


def _edges(mn: float, mx: float) -> tuple[float, float]:
    return (mn - 0.5, mx + 0.5) if mn == mx else (mn, mx)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """``(bin, lo, hi, n)`` for ``bins`` equal-width bins over min..max (last bin closed).

    The range is one scalar aggregate; the counts are a grouped count with
    map-side combine (at most ``bins`` rows per partition shuffled). Empty bins
    are included with n = 0.
    """
    (mn, mx), = value_range(df, [col])
    spark = df.sparkSession
    if mn is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n long")
    lo, hi = _edges(mn, mx)
    counts = (df.select(num_value(_c(col)).alias("v")).where(F.col("v").isNotNull())
              .select(equal_width_bin(F.col("v"), F.lit(mn), F.lit(mx), bins).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    width = (hi - lo) / bins
    all_bins = spark.createDataFrame([(i, lo + i * width, lo + (i + 1) * width) for i in range(bins)],
                                     "bin int, lo double, hi double")
    return (all_bins.join(counts, "bin", "left")
            .select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def grid_counts(df: DataFrame, x: str, y: str, group: str | None = None, bins: int = 50) -> DataFrame:
    """2-D scatter as grid counts ``(group, bx, by, n)`` — any row count, bounded output."""
    (xmn, xmx), (ymn, ymx) = value_range(df, [x, y])
    spark = df.sparkSession
    if xmn is None or ymn is None:
        return spark.createDataFrame([], "group string, bx int, by int, n long")
    g = _c(group).cast("string") if group else F.lit(None).cast("string")
    return (df.select(num_value(_c(x)).alias("x"), num_value(_c(y)).alias("y"), g.alias("group"))
            .where(F.col("x").isNotNull() & F.col("y").isNotNull())
            .select("group", equal_width_bin(F.col("x"), F.lit(xmn), F.lit(xmx), bins).alias("bx"),
                    equal_width_bin(F.col("y"), F.lit(ymn), F.lit(ymx), bins).alias("by"))
            .groupBy("group", "bx", "by").agg(F.count(F.lit(1)).alias("n")))


def scatter_sample(df: DataFrame, x: str, y: str, key: list[str], group: str | None = None, per_cell: int = 20,
                   bins: int = 50, seed: int = 42) -> DataFrame:
    """A17, points for a scatter plot: ``(group, bx, by, x, y)`` of the ``per_cell`` rows with the smallest seeded
    hash of their key in each cell of the grid (of each group), so sparse regions keep all their points.

    The same rows in any layout; rows that share a key are told apart by x and y. Each partition sends at most
    ``per_cell`` rows of a cell, however many a cell has. Rows without x or y are not plotted.
    """
    (xmn, xmx), (ymn, ymx) = value_range(df, [x, y])
    if xmn is None or ymn is None:
        return df.sparkSession.createDataFrame([], "group string, bx int, by int, x double, y double")
    g = _c(group).cast("string") if group else F.lit(None).cast("string")
    points = (df.select(num_value(_c(x)).cast("double").alias("x"), num_value(_c(y)).cast("double").alias("y"), g.alias("group"),
                        F.md5(F.concat_ws("|", key_text(key), F.lit(str(seed)))).alias("h"))
              .where(F.col("x").isNotNull() & F.col("y").isNotNull())
              .withColumn("bx", equal_width_bin(F.col("x"), F.lit(xmn), F.lit(xmx), bins))
              .withColumn("by", equal_width_bin(F.col("y"), F.lit(ymn), F.lit(ymx), bins)))
    first = Window.partitionBy("group", "bx", "by").orderBy("h", "x", "y")
    return (points.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_cell)
            .select("group", "bx", "by", "x", "y"))


def cluster_sizes(df: DataFrame, col: str = "cluster") -> DataFrame:
    """``(cluster, n)`` largest first, ties by label."""
    return df.groupBy(_c(col).alias("cluster")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster")


def anomaly_count(df: DataFrame, col: str = "is_anomaly") -> DataFrame:
    """One row ``(anomalies)``."""
    return df.agg(F.count_if(_c(col)).alias("anomalies"))


def summary_items(report: dict) -> list[tuple[str, float | None]]:
    """The figures of a task's report that a user reads first, as ``(metric, value)``: scores, rows of each
    cluster (largest first), anomalies found, or explained variance of the first components."""
    if "cluster_counts" in report:
        return [(f"cluster {k}", float(n)) for k, n in report["cluster_counts"].items()]
    if "explained_variance_ratio" in report:
        return [(f"pc{j + 1}", v) for j, v in enumerate(report["explained_variance_ratio"][:2])]
    return [(k, report[k]) for k in ("accuracy", "f1_weighted", "rmse", "r2", "anomalies") if k in report]


def metrics_long(report: dict, keys: list[str] | None, spark) -> DataFrame:
    """``(metric, value)`` rounded to 3 decimals; ``keys`` picks plain numbers of the report, None
    takes what belongs to its task (``summary_items``)."""
    items = summary_items(report) if keys is None else [(k, report.get(k)) for k in keys]
    data = [(k, None if v is None else round(float(v), 3)) for k, v in items]
    return spark.createDataFrame(data, T.StructType([T.StructField("metric", T.StringType()),
                                                     T.StructField("value", T.DoubleType())]))


def metrics_long_frame(one_row: DataFrame, keys: list[str]) -> DataFrame:
    """A18 computed distributed from a one-row metrics DataFrame (no driver round trip)."""
    items = [F.struct(F.lit(k).alias("metric"), F.round(F.col(k).cast("double"), 3).alias("value")) for k in keys]
    return one_row.select(F.explode(F.array(*items)).alias("m")).select("m.*")
