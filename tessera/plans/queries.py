"""Registered queries: one per operator of SURVEY §2, each ``(spark, sf_dir) -> DataFrame``.

Every query reads whole tables (or views Spark derives from them). Column names
match ``oracle.ORACLE_SQL``; floats are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics, profile, stats
from tessera.operators.dictionary import ranked
from tessera.operators.prep import fit_preprocessor
from tessera.operators.split import exact_split, with_row_key
from tessera.plans import views as V
from tessera.plans.tasks import run_task, with_target
from tessera.session import scratch_path
from tessera.sinks import load_model, read_report_json, save_model, write_report_json, write_results_csv
from tessera.sources.csv import inference_frame, read_csv
from tessera.sources.parquet import dtypes_frame, read_table, source_name

SEED = 42
TEST_SIZE = 0.2
#: The forests on real columns are small ones, for the time of the driver's run (see README); the full 300
#: trees at the default depth run on the step views, where the answer is known.
SMALL_FOREST = {"num_trees": 20, "max_depth": 5}

Query = Callable[[SparkSession, str], DataFrame]


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- sources / sinks

def s2_infer_lineitem(spark, sf):
    li = read_table(spark, sf, "lineitem")
    as_strings = li.select(*[F.col(c).cast("string").alias(c) for c in li.columns])
    return inference_frame(as_strings)


def s5_dtypes_orders(spark, sf):
    return dtypes_frame(spark, read_table(spark, sf, "orders"))


def k1_csv_roundtrip_orders(spark, sf):
    """K1 -> S1 -> S2: write the results-style CSV to the shared folder, scan it back."""
    path = scratch_path(spark, "k1")
    write_results_csv(V.orders_nulls(spark, sf), path)
    return read_csv(spark, path)


def s2_infer_orders_text(spark, sf):
    """S2 over texts with NA markers, booleans, an empty column and numbers of several spellings."""
    return inference_frame(V.orders_text(spark, sf))


def k1_csv_roundtrip_documents(spark, sf):
    """K1 -> S1 -> S2 on texts with line breaks, quotes and outer blanks."""
    path = scratch_path(spark, "k1")
    write_results_csv(read_table(spark, sf, "documents"), path)
    return read_csv(spark, path)


def k1_csv_roundtrip_conversations(spark, sf):
    path = scratch_path(spark, "k1")
    write_results_csv(read_table(spark, sf, "conversations"), path)
    return read_csv(spark, path)


def k2_report_roundtrip_labels(spark, sf):
    """K2: the metrics report written as one JSON document to the shared folder and read back."""
    m = metrics.classification_metrics(V.labels_pred(spark, sf)).first()
    report = {"task": "Classification", "model": "(given predictions)",
              "accuracy": float(m["accuracy"]), "f1_weighted": float(m["f1_weighted"])}
    path = scratch_path(spark, "k2")
    write_report_json(spark, report, path)
    back = read_report_json(spark, path)
    return metrics.metrics_long(back, ["accuracy", "f1_weighted"], spark)


def k3_model_roundtrip_part(spark, sf):
    """K3: the fitted PCA pipeline saved to the shared folder, loaded and applied."""
    res = _pca_part(spark, sf)
    path = scratch_path(spark, "k3")
    save_model(res.model, path)
    scored = load_model(path).transform(with_row_key(V.part_num(spark, sf), ["p_partkey"]))
    return scored.select("p_partkey", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


# ---------------------------------------------------------------- profile

def a1_shape_orders(spark, sf):
    return profile.shape(read_table(spark, sf, "orders"))


def a2_missing_lineitem_nulls(spark, sf):
    return profile.missing_counts(V.lineitem_nulls(spark, sf))


def t2_top_missing_lineitem_nulls(spark, sf):
    return profile.top_missing(V.lineitem_nulls(spark, sf), 10)


def t1_preview_orders(spark, sf):
    return profile.preview(V.orders_nulls(spark, sf), 30, order_by=["o_orderkey"])


def t4_head_csv_orders(spark, sf):
    return profile.head_csv(V.orders_nulls(spark, sf), 12, order_by=["o_orderkey"])


def t1_first_rows_orders(spark, sf):
    """Without a key: the file's first rows (``balance`` spreads them over the cores before)."""
    return profile.preview(V.orders_nulls(spark, sf), 30)


def t4_first_lines_orders(spark, sf):
    return profile.head_csv(V.orders_nulls(spark, sf), 12)


# ---------------------------------------------------------------- statistics

def a3_median_lineitem_nulls(spark, sf):
    df = V.lineitem_nulls(spark, sf)
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    med = stats.exact_medians(df, cols)
    return _small(spark, [(c, None if med[c] is None else round(med[c], 6)) for c in cols],
                  "column string, median double")


def a4_mode_part(spark, sf):
    df = read_table(spark, sf, "part")
    cols = ["p_name", "p_brand", "p_type"]
    return stats.modes_frame(stats.value_counts_long(df, cols)).select(
        "column", "n_distinct", "mode", F.col("mode_count").alias("mode_count"))


def a4_mode_lineitem_nulls(spark, sf):
    df = V.lineitem_nulls(spark, sf)
    return stats.modes_frame(stats.value_counts_long(df, ["l_returnflag", "l_linestatus"])).select(
        "column", "n_distinct", "mode", "mode_count")


def a5_mean_std_orders_nulls(spark, sf):
    df = V.orders_nulls(spark, sf)
    cols = ["o_custkey", "o_totalprice"]
    summary = stats.numeric_summary(df, cols)
    med = stats.exact_medians(df, cols, summary)
    means, stds = stats.imputed_moments(summary, med)
    return _small(spark, [(c, round(med[c], 6), round(means[c], 4), round(stds[c], 4)) for c in cols],
                  "column string, median double, mean double, std double")


def a6_categories_part(spark, sf):
    df = read_table(spark, sf, "part")
    return ranked(stats.value_counts_long(df, ["p_brand", "p_type"])).select("column", F.col("idx").cast("int").alias("idx"), "value")


def a7_class_labels_orders(spark, sf):
    return metrics.class_labels(read_table(spark, sf, "orders"), "o_orderstatus")


# ---------------------------------------------------------------- transforms

def _orders_prep(spark, sf):
    df = V.orders_nulls(spark, sf)
    model, info = fit_preprocessor(df, ["o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"])
    return df, model, info


def f1_f2_fill_orders_nulls(spark, sf):
    """The fills as the fitted stage makes them: the z-score is turned back into the filled value."""
    df, model, info = _orders_prep(spark, sf)
    out = model.stages[0].transform(df)
    filled = F.col("__num_1") * info.stds["o_totalprice"] + info.means["o_totalprice"]
    return out.select("o_orderkey", F.round(filled, 4).alias("o_totalprice"), F.col("__cat_1").alias("o_orderpriority"))


def f3_zscore_orders_nulls(spark, sf):
    df, model, _ = _orders_prep(spark, sf)
    out = model.stages[0].transform(df)
    return out.select("o_orderkey", F.round("__num_0", 6).alias("z_custkey"), F.round("__num_1", 6).alias("z_totalprice"))


def _onehot(df, model, info, key: str):
    """F4/F5 read back from the assembled vector: ``(key, feature)`` for each entry that is not 0. A
    sparse vector has its indices, a dense one is its own index."""
    v = F.unwrap_udt(F.col("features"))
    vec = model.transform(df).select(key, v.alias("v"))
    at = F.coalesce("v.indices", F.sequence(F.lit(0), F.size("v.values") - 1))
    hits = vec.select(key, F.explode(F.arrays_zip(at.alias("i"), F.col("v.values").alias("x"))).alias("e")).where("e.x <> 0")
    return hits.select(key, F.col("e.i").alias("i")).join(info.features(df.sparkSession), "i").select(key, "feature")


def f4_onehot_orders_nulls(spark, sf):
    df = V.orders_nulls(spark, sf)
    model, info = fit_preprocessor(df, [], ["o_orderstatus", "o_orderpriority"])
    return _onehot(df, model, info, "o_orderkey")


def f4_onehot_customer(spark, sf):
    """One level for each customer, by a dictionary that the driver never sees."""
    df = read_table(spark, sf, "customer", ["c_custkey", "c_name"])
    model, info = fit_preprocessor(df, [], ["c_name"], driver_levels=0)
    return _onehot(df, model, info, "c_custkey")


def p1_dropna_orders_nulls(spark, sf):
    """P1 as the engine does it: the rows that reach a supervised task's split are those with a target."""
    df = V.orders_nulls(spark, sf)
    return with_target(df, "o_totalprice").select("o_orderkey", "o_totalprice")


def r1_split_orders(spark, sf):
    o = with_row_key(read_table(spark, sf, "orders", ["o_orderkey"]), ["o_orderkey"])
    return exact_split(o, TEST_SIZE, SEED).select("o_orderkey", "is_test")


def r1_split_lineitem(spark, sf):
    li = with_row_key(read_table(spark, sf, "lineitem", V.LINEITEM_KEY), V.LINEITEM_KEY)
    return exact_split(li, 0.07, SEED).select(*V.LINEITEM_KEY, "is_test")


def r1_split_lineitem_suppkey(spark, sf):
    """A key that repeats: rows of the cut key are told apart by the full row."""
    li = with_row_key(read_table(spark, sf, "lineitem", V.LINEITEM_KEY), ["l_suppkey"])
    out = exact_split(li, TEST_SIZE, SEED)
    return out.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


# ---------------------------------------------------------------- metrics

def a10_confusion_labels(spark, sf):
    return metrics.confusion_long(V.labels_pred(spark, sf))


def a11_a12_classification_metrics_labels(spark, sf):
    m = metrics.classification_metrics(V.labels_pred(spark, sf))
    return m.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("f1_weighted", 6).alias("f1_weighted"))


def a13_a14_regression_metrics_lineitem(spark, sf):
    m = metrics.regression_metrics(V.lineitem_pred(spark, sf))
    return m.select("n", F.round("mse", 4).alias("mse"), F.round("rmse", 6).alias("rmse"), F.round("r2", 6).alias("r2"))


def a15_histogram_events(spark, sf):
    h = metrics.histogram(read_table(spark, sf, "events", ["value"]), "value", 30)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


def a2_missing_nan_lineitem(spark, sf):
    return profile.missing_counts(V.lineitem_nan(spark, sf))


def a15_histogram_nan_events(spark, sf):
    h = metrics.histogram(V.events_nan(spark, sf), "value", 30)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


def a16_axis_range_lineitem(spark, sf):
    r = metrics.axis_range(V.lineitem_pred(spark, sf))
    return r.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def a17_grid_lineitem(spark, sf):
    li = read_table(spark, sf, "lineitem", ["l_quantity", "l_extendedprice", "l_returnflag"])
    return metrics.grid_counts(li, "l_quantity", "l_extendedprice", group="l_returnflag", bins=50)


def a17_scatter_lineitem(spark, sf):
    """The points of a scatter plot, 5 a cell and group at most, the same in any layout."""
    li = read_table(spark, sf, "lineitem", [*V.LINEITEM_KEY, "l_quantity", "l_extendedprice", "l_returnflag"])
    return metrics.scatter_sample(li, "l_quantity", "l_extendedprice", V.LINEITEM_KEY, group="l_returnflag", per_cell=5)


def a10_confusion_sparse_orders(spark, sf):
    """A10 with a class for each customer: ranks and cells without a driver list."""
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    moved = F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)
    pred = o.select(F.col("o_custkey").cast("string").alias("y_true"), moved.cast("string").alias("y_pred"))
    return metrics.confusion_sparse(metrics.confusion_long(pred), numeric=True)


def a8_cluster_sizes_embeddings(spark, sf):
    return metrics.cluster_sizes(read_table(spark, sf, "embeddings", ["label"]), "label")


def a9_anomaly_count_events(spark, sf):
    ev = read_table(spark, sf, "events", ["value"])
    scored = ev.select((F.lit(100.0) - F.col("value") < 0).alias("is_anomaly"))
    return metrics.anomaly_count(scored)


def a18_metrics_summary_labels(spark, sf):
    m = metrics.classification_metrics(V.labels_pred(spark, sf))
    return metrics.metrics_long_frame(m, ["accuracy", "f1_weighted"])


def a19_profile_orders_nulls(spark, sf):
    return profile.profile_frame(spark, V.orders_nulls(spark, sf), source_name(f"{sf}/orders.parquet"), {}, order_by=["o_orderkey"])


# ---------------------------------------------------------------- models with closed forms

def m3_ridge_lineitem(spark, sf):
    """Minimum slice: null-injected feature -> split -> median fill -> z-score -> ridge -> RMSE/R2."""
    li = read_table(spark, sf, "lineitem")
    df = li.select(*V.LINEITEM_KEY,
                   F.when(F.col("l_orderkey") % 10 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
                   (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    res = run_task(df, "Regression", "Ridge Regression", "net", TEST_SIZE, SEED, key_cols=V.LINEITEM_KEY,
                   exclude=V.LINEITEM_KEY)
    m = metrics.regression_metrics(res.results)
    return m.select("n", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


def m9_report_regression_lineitem(spark, sf):
    res = run_task(V.lineitem_reg(spark, sf), "Regression", "Ridge Regression", "net", TEST_SIZE, SEED,
                   key_cols=V.LINEITEM_KEY, exclude=V.LINEITEM_KEY)
    return metrics.metrics_long(res.report, ["rmse", "r2"], spark)


def m3_ridge_clashing_names(spark, sf):
    """M9/R1 on a view whose features have the names an engine might use itself."""
    res = run_task(V.lineitem_clash(spark, sf), "Regression", "Ridge Regression", "net", TEST_SIZE, SEED,
                   key_cols=V.LINEITEM_KEY, exclude=V.LINEITEM_KEY)
    return metrics.metrics_long(res.report, ["rmse", "r2"], spark)


def m3_ridge_wide_orders(spark, sf):
    """M3 beyond the normal equations: one-hot levels of a text key, more than 4,096 of them at sf0.01."""
    res = run_task(V.orders_wide(spark, sf), "Regression", "Ridge Regression", "o_totalprice", TEST_SIZE, SEED,
                   key_cols=["o_orderkey"], exclude=["o_orderkey"])
    m = metrics.regression_metrics(res.results)
    return m.select("n", F.round("rmse", 1).alias("rmse"), F.round("r2", 4).alias("r2"))


def _pca_part(spark, sf):
    df = V.part_num(spark, sf)
    return run_task(df, "Dimensionality Reduction", "PCA", None, key_cols=["p_partkey"], exclude=["p_partkey"])


def m7_pca_scores_part(spark, sf):
    res = _pca_part(spark, sf)
    return res.results.select("p_partkey", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


def m7_pca_evr_part(spark, sf):
    res = _pca_part(spark, sf)
    evr = res.report["explained_variance_ratio"]
    return _small(spark, [(i + 1, round(v, 6)) for i, v in enumerate(evr)], "component int, ratio double")


def _pca_blocks(spark, sf):
    """M7 as for wide tables: no covariance matrix."""
    return run_task(V.part_num(spark, sf), "Dimensionality Reduction", "PCA", None, key_cols=["p_partkey"], exclude=["p_partkey"],
                    params={"matrix_features": 0})


def m7_pca_blocks_scores_part(spark, sf):
    res = _pca_blocks(spark, sf)
    return res.results.select("p_partkey", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


def m7_pca_blocks_evr_part(spark, sf):
    evr = _pca_blocks(spark, sf).report["explained_variance_ratio"]
    return _small(spark, [(i + 1, round(v, 6)) for i, v in enumerate(evr)], "component int, ratio double")


def m1_logreg_closed_form_lineitem(spark, sf):
    """Logistic regression with one feature, checked against Newton's method in SQL."""
    li = read_table(spark, sf, "lineitem", V.LINEITEM_KEY + ["l_extendedprice", "l_quantity"])
    df = li.select(*V.LINEITEM_KEY, "l_extendedprice", (F.col("l_quantity") > 25).alias("is_big"))
    res = run_task(df, "Classification", "Logistic Regression", "is_big", TEST_SIZE, SEED, key_cols=V.LINEITEM_KEY,
                   exclude=V.LINEITEM_KEY, params={"logreg_tol": 1e-10})
    return metrics.confusion_long(res.results)


def m1_logreg_lineitem(spark, sf):
    res = run_task(V.lineitem_cls(spark, sf), "Classification", "Logistic Regression", "is_big", TEST_SIZE, SEED,
                   key_cols=V.LINEITEM_KEY, exclude=V.LINEITEM_KEY)
    return res.results


# ---------------------------------------------------------------- models whose answer follows from the data

def m2_rf_classifier_steps(spark, sf):
    """M2 with the reference's 300 trees: the class is decided by the line number alone."""
    res = run_task(V.lineitem_steps(spark, sf), "Classification", "Random Forest Classifier", "size_class", TEST_SIZE, SEED,
                   key_cols=V.LINEITEM_KEY, exclude=[*V.LINEITEM_KEY[:3], "step"])
    return metrics.confusion_long(res.results)


def m4_rf_regressor_steps(spark, sf):
    """M4 with the reference's 300 trees: the target is a step function of the line number."""
    res = run_task(V.lineitem_steps(spark, sf), "Regression", "Random Forest Regressor", "step", TEST_SIZE, SEED,
                   key_cols=V.LINEITEM_KEY, exclude=[*V.LINEITEM_KEY[:3], "size_class"])
    return res.results.groupBy("y_true", F.round("y_pred", 6).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def _groups(spark, sf):
    return run_task(V.lineitem_groups(spark, sf), "Clustering", "KMeans", None, key_cols=V.LINEITEM_KEY,
                    exclude=[*V.LINEITEM_KEY, "grp"])


def m5_kmeans_groups(spark, sf):
    """M5: three groups far apart; the partition and the order by size are known."""
    return _groups(spark, sf).results.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("n"))


def m8_cluster_view_groups(spark, sf):
    """M8: the PCA view keeps the groups apart: no grid cell holds two clusters, and all rows are there."""
    grid = _groups(spark, sf).plot["data"]
    cells = grid.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("clusters"))
    return (grid.join(cells, ["bx", "by"]).groupBy(F.col("group").alias("cluster"))
            .agg(F.sum("n").alias("n"), F.max("clusters").alias("clusters_in_a_cell")))


def m6_iforest_nation(spark, sf):
    """M6 on one 0/1 feature and fewer rows than a sample: every tree splits once, the score is a formula."""
    res = run_task(V.nation_flag(spark, sf), "Anomaly Detection", "Isolation Forest", None, key_cols=["n_nationkey"],
                   exclude=["n_nationkey"])
    return res.results.select("n_nationkey", "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"))


def a18_summary_clusters(spark, sf):
    return metrics.metrics_long(_groups(spark, sf).report, None, spark)


def a18_summary_anomalies_nation(spark, sf):
    res = run_task(V.nation_flag(spark, sf), "Anomaly Detection", "Isolation Forest", None, key_cols=["n_nationkey"],
                   exclude=["n_nationkey"])
    return metrics.metrics_long(res.report, None, spark)


def a18_summary_pca_part(spark, sf):
    return metrics.metrics_long(_pca_part(spark, sf).report, None, spark)


# ---------------------------------------------------------------- randomised models (rows-only check)

def m2_rf_classifier_orders(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"])
    res = run_task(o, "Classification", "Random Forest Classifier", "o_orderstatus", TEST_SIZE, SEED,
                   params=SMALL_FOREST, key_cols=["o_orderkey"], exclude=["o_orderkey"])
    return res.results


def m4_rf_regressor_lineitem(spark, sf):
    res = run_task(V.lineitem_reg(spark, sf), "Regression", "Random Forest Regressor", "net", TEST_SIZE, SEED,
                   params=SMALL_FOREST, key_cols=V.LINEITEM_KEY, exclude=V.LINEITEM_KEY)
    return res.results


def m5_kmeans_embeddings(spark, sf):
    res = run_task(V.embeddings_cols(spark, sf), "Clustering", "KMeans", None, key_cols=["vec_id"],
                   exclude=["vec_id", "label"])
    return res.results.select("vec_id", "label", "cluster")


def m6_iforest_events(spark, sf):
    ev = read_table(spark, sf, "events", ["event_id", "value", "event_type", "user_id"])
    res = run_task(ev, "Anomaly Detection", "Isolation Forest", None, key_cols=["event_id"], exclude=["event_id"])
    return res.results.select("event_id", "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"))


def m8_cluster_view_embeddings(spark, sf):
    res = run_task(V.embeddings_cols(spark, sf), "Clustering", "KMeans", None, key_cols=["vec_id"],
                   exclude=["vec_id", "label"])
    return res.plot["data"]


QUERIES: dict[str, Query] = {
    "s2_infer_lineitem": s2_infer_lineitem,
    "s5_dtypes_orders": s5_dtypes_orders,
    "k1_csv_roundtrip_orders": k1_csv_roundtrip_orders,
    "a1_shape_orders": a1_shape_orders,
    "a2_missing_lineitem_nulls": a2_missing_lineitem_nulls,
    "t2_top_missing_lineitem_nulls": t2_top_missing_lineitem_nulls,
    "t1_preview_orders": t1_preview_orders,
    "t4_head_csv_orders": t4_head_csv_orders,
    "t1_first_rows_orders": t1_first_rows_orders,
    "t4_first_lines_orders": t4_first_lines_orders,
    "a3_median_lineitem_nulls": a3_median_lineitem_nulls,
    "a4_mode_part": a4_mode_part,
    "a4_mode_lineitem_nulls": a4_mode_lineitem_nulls,
    "a5_mean_std_orders_nulls": a5_mean_std_orders_nulls,
    "a6_categories_part": a6_categories_part,
    "a7_class_labels_orders": a7_class_labels_orders,
    "f1_f2_fill_orders_nulls": f1_f2_fill_orders_nulls,
    "f3_zscore_orders_nulls": f3_zscore_orders_nulls,
    "f4_onehot_orders_nulls": f4_onehot_orders_nulls,
    "p1_dropna_orders_nulls": p1_dropna_orders_nulls,
    "r1_split_orders": r1_split_orders,
    "r1_split_lineitem": r1_split_lineitem,
    "a10_confusion_labels": a10_confusion_labels,
    "a11_a12_classification_metrics_labels": a11_a12_classification_metrics_labels,
    "a13_a14_regression_metrics_lineitem": a13_a14_regression_metrics_lineitem,
    "a15_histogram_events": a15_histogram_events,
    "a16_axis_range_lineitem": a16_axis_range_lineitem,
    "a17_grid_lineitem": a17_grid_lineitem,
    "a17_scatter_lineitem": a17_scatter_lineitem,
    "a10_confusion_sparse_orders": a10_confusion_sparse_orders,
    "a8_cluster_sizes_embeddings": a8_cluster_sizes_embeddings,
    "a9_anomaly_count_events": a9_anomaly_count_events,
    "a18_metrics_summary_labels": a18_metrics_summary_labels,
    "a19_profile_orders_nulls": a19_profile_orders_nulls,
    "m3_ridge_lineitem": m3_ridge_lineitem,
    "m7_pca_scores_part": m7_pca_scores_part,
    "m7_pca_evr_part": m7_pca_evr_part,
    "m7_pca_blocks_scores_part": m7_pca_blocks_scores_part,
    "m7_pca_blocks_evr_part": m7_pca_blocks_evr_part,
    "m1_logreg_closed_form_lineitem": m1_logreg_closed_form_lineitem,
    "k2_report_roundtrip_labels": k2_report_roundtrip_labels,
    "k3_model_roundtrip_part": k3_model_roundtrip_part,
    "m1_logreg_lineitem": m1_logreg_lineitem,
    "m2_rf_classifier_orders": m2_rf_classifier_orders,
    "m4_rf_regressor_lineitem": m4_rf_regressor_lineitem,
    "m5_kmeans_embeddings": m5_kmeans_embeddings,
    "m6_iforest_events": m6_iforest_events,
    "m8_cluster_view_embeddings": m8_cluster_view_embeddings,
    "m9_report_regression_lineitem": m9_report_regression_lineitem,
    "s2_infer_orders_text": s2_infer_orders_text,
    "k1_csv_roundtrip_documents": k1_csv_roundtrip_documents,
    "k1_csv_roundtrip_conversations": k1_csv_roundtrip_conversations,
    "f4_onehot_customer": f4_onehot_customer,
    "r1_split_lineitem_suppkey": r1_split_lineitem_suppkey,
    "a2_missing_nan_lineitem": a2_missing_nan_lineitem,
    "a15_histogram_nan_events": a15_histogram_nan_events,
    "m3_ridge_clashing_names": m3_ridge_clashing_names,
    "m3_ridge_wide_orders": m3_ridge_wide_orders,
    "m2_rf_classifier_steps": m2_rf_classifier_steps,
    "m4_rf_regressor_steps": m4_rf_regressor_steps,
    "m5_kmeans_groups": m5_kmeans_groups,
    "m8_cluster_view_groups": m8_cluster_view_groups,
    "m6_iforest_nation": m6_iforest_nation,
    "a18_summary_clusters": a18_summary_clusters,
    "a18_summary_anomalies_nation": a18_summary_anomalies_nation,
    "a18_summary_pca_part": a18_summary_pca_part,
}
