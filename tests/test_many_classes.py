from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.plans.tasks import run_task


def pairs(spark, n=100_000):
    return spark.range(2 * n, numPartitions=6).select((F.col("id") % n).cast("string").alias("y_true"),
                                                      ((F.col("id") + F.col("id") % 2) % n).cast("string").alias("y_pred"))


def test_100_000_classes_without_a_driver_list(spark, monkeypatch):
    cls = type(spark.range(1))
    monkeypatch.setattr(cls, "toPandas", lambda self: (_ for _ in ()).throw(AssertionError("values to the driver")))
    long = metrics.confusion_long(pairs(spark))
    cells = metrics.confusion_sparse(long, numeric=True)
    got = cells.agg(F.count(F.lit(1)), F.sum("n"), F.min("i"), F.max("j"),
                    F.count_if((F.col("i") == F.col("y_true").cast("long")) & (F.col("j") == F.col("y_pred").cast("long")))).first()
    assert tuple(got) == (100_000, 200_000, 0, 99_998, 100_000)
    m = metrics.metrics_of_confusion(long).first()
    assert m["n"] == 200_000 and m["accuracy"] == 0.5


def test_text_order_nulls_and_empty(spark):
    df = spark.createDataFrame([("10", "2"), ("2", "2"), ("10", "2"), (None, "2"), ("9", None)], "y_true string, y_pred string")
    long = metrics.confusion_long(df)
    text = {(r.i, r.j): r.n for r in metrics.confusion_sparse(long, False).collect()}
    number = {(r.i, r.j): r.n for r in metrics.confusion_sparse(long, True).collect()}
    assert text == {(0, 1): 2, (1, 1): 1} and number == {(2, 0): 2, (0, 0): 1}
    assert metrics.confusion_sparse(metrics.confusion_long(df.limit(0)), True).count() == 0


def test_task_beyond_dense_classes(spark):
    df = spark.range(900).selectExpr("id", "cast(id % 30 as double) as x", "concat('c', id % 30) as y")
    run = dict(params={"num_trees": 3, "max_depth": 8}, key_cols=["id"], exclude=["id"])
    dense = run_task(df, "Classification", "Random Forest Classifier", "y", **run)
    sparse = run_task(df, "Classification", "Random Forest Classifier", "y", **{**run, "params": {**run["params"], "dense_classes": 20}})
    assert sparse.report["confusion_matrix"] is None and sparse.report["class_labels"] is None
    assert abs(sparse.report["accuracy"] - dense.report["accuracy"]) < 1e-12
    assert abs(sparse.report["f1_weighted"] - dense.report["f1_weighted"]) < 1e-12
    want = {(t, p): n for t, row in zip(dense.report["class_labels"], dense.report["confusion_matrix"])
            for p, n in zip(dense.report["class_labels"], row) if n}
    got = sparse.plot["data"].collect()
    assert {(r.y_true, r.y_pred): r.n for r in got} == want
    assert all(dense.report["class_labels"][r.i] == r.y_true for r in got)
    dense.release(), sparse.release()
