import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.operators.prep import fit_preprocessor
from tessera.sinks import load_model, save_model


def test_unseen_category_encodes_to_zeros(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "a")], "x double, c string")
    test = spark.createDataFrame([(1.0, "a"), (2.0, "zz")], "x double, c string")
    model, info = fit_preprocessor(train, ["x"], ["c"])
    assert info.feature_names == ["x", "c_a", "c_b"]
    rows = model.transform(test).select(vector_to_array("features").alias("f")).collect()
    assert rows[0]["f"][1:] == [1.0, 0.0]
    assert rows[1]["f"][1:] == [0.0, 0.0]


def test_fill_scale_order_and_drops(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, "b"), (2.0, 5.0, None, None), (None, 5.0, None, "b"),
                                (10.0, 5.0, None, "a")], "x double, k double, e double, c string")
    model, info = fit_preprocessor(df, ["x", "k", "e"], ["c"])
    assert info.num_cols == ["x", "k"] and info.dropped == ["e"]
    assert info.medians["x"] == 2.0 and info.modes["c"] == "b"
    filled = np.array([1.0, 2.0, 2.0, 10.0])
    feats = np.array([r["f"] for r in model.transform(df).select(vector_to_array("features").alias("f")).collect()])
    assert np.allclose(feats[:, 0], (filled - filled.mean()) / filled.std())
    assert np.allclose(feats[:, 1], 0.0)  # constant column -> 0
    assert feats[:, 2:].tolist() == [[0, 1], [0, 1], [0, 1], [1, 0]]  # null -> mode 'b'


def test_preprocessor_save_load(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "x double, c string")
    model, _ = fit_preprocessor(df, ["x"], ["c"])
    path = str(tmp_path / "prep")
    save_model(model, path)
    again = load_model(path)
    a = [r["features"] for r in model.transform(df).collect()]
    b = [r["features"] for r in again.transform(df).collect()]
    assert a == b


def test_weighted_f1_with_prediction_only_label(spark):
    pred = spark.createDataFrame([("0", "0"), ("0", "1"), ("1", "1"), ("1", "2"), ("1", "1")], "y_true string, y_pred string")
    r = metrics.classification_metrics(pred).first()
    assert abs(r["f1_weighted"] - 2 / 3) < 1e-12 and abs(r["accuracy"] - 0.6) < 1e-12


def test_r2_constant_truth(spark):
    perfect = spark.createDataFrame([(3.0, 3.0), (3.0, 3.0)], "y_true double, y_pred double")
    off = spark.createDataFrame([(3.0, 3.0), (3.0, 4.0)], "y_true double, y_pred double")
    assert metrics.regression_metrics(perfect).first()["r2"] == 1.0
    assert metrics.regression_metrics(off).first()["r2"] == 0.0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 30]], "v double")
    h = {r["bin"]: r["n"] for r in metrics.histogram(df, "v", 30).collect()}
    assert len(h) == 30 and h[29] == 1 and h[0] == 1 and sum(h.values()) == 5
    const = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    hc = {r["bin"]: r["n"] for r in metrics.histogram(const, "v", 30).collect()}
    assert hc[15] == 2 and sum(hc.values()) == 2


def test_numpy_histogram_agrees(spark):
    rng = np.random.default_rng(5)
    v = rng.exponential(2.0, 5000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = [r["n"] for r in metrics.histogram(df, "v", 30).orderBy("bin").collect()]
    want, _ = np.histogram(v, bins=30)
    assert got == want.tolist()


def test_label_order_numeric():
    assert metrics.label_order(["10", "2"], numeric=True) == ["2", "10"]
    assert metrics.label_order(["b", "a"], numeric=False) == ["a", "b"]


def test_grid_counts_total(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("x"), (F.col("id") % 11).alias("y"))
    g = metrics.grid_counts(df, "x", "y", bins=10)
    assert g.agg(F.sum("n")).first()[0] == 1000


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (3.0, "b"), (None, "b")], "x double, c string")
    model, info = fit_preprocessor(df, ["x"], ["c"])
    assert info.medians["x"] == 2.0
    xs = [r["f"][0] for r in model.transform(df).select(vector_to_array("features").alias("f")).collect()]
    assert all(v == v for v in xs)  # no NaN survives the fill
