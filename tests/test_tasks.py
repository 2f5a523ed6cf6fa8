import json

import pytest
from pyspark.sql import functions as F

from tessera.plans.tasks import run_task
from tessera.sinks import load_model, read_report_json, save_model, write_report_json, write_results_csv
from tessera.sources.csv import read_csv


@pytest.fixture()
def small(spark):
    return spark.createDataFrame([(i, float(i % 13), "a" if i % 3 else "b", float(i % 13) * 2 + 1) for i in range(120)],
                                 "id long, x double, c string, y double")


def test_guards(spark, small):
    with pytest.raises(ValueError, match="^Dataset is empty.$"):
        run_task(small.limit(0), "Regression", "Ridge Regression", "y")
    with pytest.raises(ValueError, match="^Target column is required.$"):
        run_task(small, "Regression", "Ridge Regression", None)
    with pytest.raises(ValueError, match="^Target column not found in dataset.$"):
        run_task(small, "Regression", "Ridge Regression", "nope")
    with pytest.raises(ValueError, match="^Unknown task$"):
        run_task(small, "Forecasting", "PCA", None)
    for task, msg in [("Classification", "Unknown classification model"), ("Regression", "Unknown regression model"),
                      ("Clustering", "Unknown clustering model"), ("Anomaly Detection", "Unknown anomaly model"),
                      ("Dimensionality Reduction", "Unknown reduction model")]:
        with pytest.raises(ValueError, match=f"^{msg}$"):
            run_task(small, task, "Nope", "y")


def test_null_targets_dropped(spark, small):
    df = small.withColumn("y", F.when(F.col("id") % 4 == 0, None).otherwise(F.col("y")))
    res = run_task(df, "Regression", "Ridge Regression", "y", key_cols=["id"], exclude=["id"])
    assert res.results.count() == 18  # ceil(0.2 * 90)
    assert res.report["r2"] > 0.99
    res.release()


def test_sinks_round_trip(spark, small, tmp_path):
    res = run_task(small, "Regression", "Ridge Regression", "y", key_cols=["id"], exclude=["id"])
    out = str(tmp_path / "results")
    write_results_csv(res.results, out)
    back = read_csv(spark, out)
    assert sorted(back.columns) == ["row_key", "y_pred", "y_true"]
    assert back.count() == res.results.count()
    rp = str(tmp_path / "report")
    write_report_json(spark, res.report, rp)
    assert read_report_json(spark, rp) == json.loads(json.dumps(res.report))
    mp = str(tmp_path / "model")
    save_model(res.model, mp)
    test = small.where("id < 10")
    a = [r["y_pred"] for r in res.model.transform(test).collect()]
    b = [r["y_pred"] for r in load_model(mp).transform(test).collect()]
    assert a == b
    res.release()


def test_unsupervised_results_keep_all_columns(spark, small):
    res = run_task(small, "Clustering", "KMeans", None)
    assert res.results.columns == small.columns + ["cluster"]
    assert set(res.report["cluster_counts"]) <= {0, 1, 2} and sum(res.report["cluster_counts"].values()) == 120
    counts = list(res.report["cluster_counts"].values())
    assert counts == sorted(counts, reverse=True)
    res.release()
    res = run_task(small, "Dimensionality Reduction", "PCA", None, exclude=["id"])
    assert res.results.columns == small.columns + ["pc1", "pc2"] and res.report["components"] == 2
    res.release()


def test_pca_needs_two_features(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    with pytest.raises(ValueError, match="at least 2 features"):
        run_task(df, "Dimensionality Reduction", "PCA", None)


def test_nan_target_dropped(spark, small):
    df = small.withColumn("y", F.when(F.col("id") % 4 == 0, float("nan")).otherwise(F.col("y")))
    res = run_task(df, "Regression", "Ridge Regression", "y", key_cols=["id"], exclude=["id"])
    assert res.results.count() == 18
    res.release()


def test_degenerate_inputs(spark):
    one = spark.createDataFrame([(i, float(i), "a") for i in range(50)], "id long, x double, y string")
    with pytest.raises(ValueError, match="at least 2 classes"):
        run_task(one, "Classification", "Logistic Regression", "y", key_cols=["id"], exclude=["id"])
    with pytest.raises(ValueError, match="n_samples=2 should be >= n_clusters=3"):
        run_task(one.limit(2), "Clustering", "KMeans", None, key_cols=["id"], exclude=["id"])
    with pytest.raises(ValueError, match="n_components=2"):
        run_task(one.limit(1), "Dimensionality Reduction", "PCA", None, key_cols=["id"], exclude=["id"])
    res = run_task(one.limit(1), "Anomaly Detection", "Isolation Forest", None, key_cols=["id"], exclude=["id"])
    assert res.results.count() == 1
    res.release()


def test_csv_end_to_end(spark, tmp_path):
    """The reference's flow: a CSV with NA markers, bool and date-like text -> classification -> exports."""
    lines = ["id,amount,flag,day,segment,label"]
    for i in range(300):
        amount = "NA" if i % 17 == 0 else f"{(i % 50) * 1.5:.1f}"
        seg = "" if i % 13 == 0 else ("retail" if i % 3 else "corp")
        label = "high" if (i % 50) >= 25 else "low"
        lines.append(f"{i},{amount},{'True' if i % 2 else 'False'},2020-01-{1 + i % 28:02d},{seg},{label}")
    path = str(tmp_path / "data.csv")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    from tessera.__main__ import main

    out = str(tmp_path / "out")
    assert main(["run", path, "--task", "Classification", "--model", "Logistic Regression", "--target", "label",
                 "--key", "id", "--exclude", "id", "--out", out]) == 0
    report = read_report_json(spark, f"{out}/report")
    assert report["class_labels"] == ["high", "low"] and report["accuracy"] > 0.9
    assert read_csv(spark, f"{out}/results").count() == 60
    assert main(["profile", path, "--out", str(tmp_path / "profile")]) == 0
    prof = read_csv(spark, str(tmp_path / "profile"))
    got = {(r["section"], r["name"]): r["value"] for r in prof.collect()}
    assert got[("shape", "rows")] == "300" and got[("missing", "amount")] == "18"
    assert got[("dtype", "flag")] == "boolean" and got[("dtype", "day")] == "string"
