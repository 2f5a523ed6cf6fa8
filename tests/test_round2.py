"""Cases that once went wrong: files that damage texts, columns whose names clash, limits, and fits
that depended on where rows lie."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import key_text
from tessera.operators import metrics, profile, stats
from tessera.operators.split import exact_split, with_row_key
from tessera.plans.tasks import run_task
from tessera.sinks import write_results_csv
from tessera.sources.csv import read_csv


def _file(tmp_path, text):
    p = os.path.join(tmp_path, "x.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


# ---------------------------------------------------------------- CSV

def test_csv_round_trip_keeps_texts(spark, tmp_path):
    rows = [(1, "  lead and trail  "), (2, "line\nbreak, comma and \"quote\""), (3, "\t"), (4, "two\n\nbreaks"), (5, "plain")]
    path = str(tmp_path / "out")
    write_results_csv(spark.createDataFrame(rows, "k long, t string").repartition(3), path)
    assert sorted(tuple(r) for r in read_csv(spark, path).collect()) == rows


def test_csv_extra_field_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="more than 2 fields"):
        read_csv(spark, _file(tmp_path, "a,b\n1,2\n3,4,5\n")).collect()


def test_csv_short_row_is_filled(spark, tmp_path):
    assert sorted(tuple(r) for r in read_csv(spark, _file(tmp_path, "a,b\n1,2\n3\n")).collect()) == [(1, 2), (3, None)]


def test_csv_blank_first_lines(spark, tmp_path):
    df = read_csv(spark, _file(tmp_path, "\n\na,b\n1,x\n\n2,y\n"))
    assert df.columns == ["a", "b"] and sorted(tuple(r) for r in df.collect()) == [(1, "x"), (2, "y")]


def test_csv_headers_that_differ_in_case(spark, tmp_path):
    df = read_csv(spark, _file(tmp_path, "a,A,b\n1,2,3\n"))
    assert df.columns == ["a", "A.1", "b"] and tuple(df.first()) == (1, 2, 3)


def test_csv_quoted_header_with_line_break(spark, tmp_path):
    df = read_csv(spark, _file(tmp_path, '"a\nb",c\n1,"x\ny"\n'))
    assert df.columns == ["a\nb", "c"] and tuple(df.first()) == (1, "x\ny")


def test_csv_without_content(spark, tmp_path):
    with pytest.raises(ValueError, match="No columns"):
        read_csv(spark, _file(tmp_path, "\n\n"))


# ---------------------------------------------------------------- names

def _reg(spark, name):
    return spark.createDataFrame([(i, float(i % 50), float((i * 7) % 11), 10.0 * (i % 50) + (i * 7) % 11) for i in range(400)],
                                 f"id long, `{name}` double, other double, y double")


@pytest.mark.parametrize("name", ["is_test", "_h", "row_key", "features", "label", "prediction", "y_pred", "Row_Key"])
def test_feature_names_do_not_clash(spark, name):
    res = run_task(_reg(spark, name), "Regression", "Ridge Regression", "y", key_cols=["id"], exclude=["id"])
    assert res.report["r2"] > 0.999
    res.release()


def test_class_feature_named_y_pred(spark):
    df = spark.range(300).selectExpr("id", "cast(id % 2 as double) as y_pred", "if(id % 2 = 0, 'a', 'b') as y")
    res = run_task(df, "Classification", "Logistic Regression", "y", key_cols=["id"], exclude=["id"])
    assert res.report["accuracy"] == 1.0
    res.release()


def test_reserved_name_is_refused(spark):
    with pytest.raises(ValueError, match="__features"):
        run_task(_reg(spark, "__features"), "Regression", "Ridge Regression", "y")


def test_result_columns_replace_columns_of_their_name(spark):
    df = spark.createDataFrame([(i, float(i % 3) * 100, float(i)) for i in range(90)], "id long, cluster double, pc1 double")
    res = run_task(df, "Clustering", "KMeans", None, key_cols=["id"], exclude=["id", "pc1"])
    assert res.results.columns == ["id", "pc1", "cluster"] and res.results.select("cluster").distinct().count() == 3
    res = run_task(df, "Dimensionality Reduction", "PCA", None, key_cols=["id"], exclude=["id"])
    assert res.results.columns == ["id", "cluster", "pc1", "pc2"]
    df = df.withColumnRenamed("cluster", "anomaly_score")
    assert run_task(df, "Anomaly Detection", "Isolation Forest", None, key_cols=["id"], exclude=["id"]).results.columns == [
        "id", "pc1", "is_anomaly", "anomaly_score"]


def test_key_text_tells_tuples_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("\\N", "x"), ("a\\", "|c"), ("a\\|", "c"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select(key_text(["a", "b"]).alias("k"))
    assert df.distinct().count() == len(rows)


def test_split_with_a_key_that_repeats_is_stable(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as k")
    sides = [frozenset(r.id for r in exact_split(with_row_key(df.repartition(n), ["k"]), 0.5, 1).where("is_test").collect()) for n in (1, 4, 9)]
    assert len(set(sides)) == 1 and len(sides[0]) == 500


def test_split_flag_must_be_free(spark):
    with pytest.raises(ValueError, match="is_test"):
        exact_split(with_row_key(spark.range(5).withColumnRenamed("id", "is_test"), ["is_test"]), 0.5)


# ---------------------------------------------------------------- missing values

def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert profile.missing_counts(df).first()["n_missing"] == 2
    h = metrics.histogram(df, "x", 2).orderBy("bin").collect()
    assert [(r.lo, r.hi, r.n) for r in h] == [(1.0, 2.0, 1), (2.0, 3.0, 1)]
    grid = metrics.grid_counts(df.select("x", F.col("x").alias("y")), "x", "y", bins=2).collect()
    assert sum(r.n for r in grid) == 2


# ---------------------------------------------------------------- no limits

def test_many_classes(spark):
    df = spark.range(4500).selectExpr("id", "cast(id % 1500 as double) as x", "concat('c', id % 1500) as y")
    res = run_task(df, "Classification", "Random Forest Classifier", "y", params={"num_trees": 1, "max_depth": 2}, key_cols=["id"], exclude=["id"])
    assert 500 < len(res.report["class_labels"]) <= 1500
    res.release()


def test_id_like_text_column(spark):
    df = spark.range(2500).selectExpr("id", "concat('v', id) as c", "cast(id % 7 as double) as x", "cast(id % 7 as double) * 2 as y")
    res = run_task(df, "Regression", "Ridge Regression", "y", key_cols=["id"], exclude=["id"])
    assert res.report["r2"] > 0.99
    res.release()


def test_ridge_above_the_normal_equations(spark, monkeypatch):
    from tessera.operators import models

    df = spark.range(600).selectExpr("id", "concat('v', id % 40) as c", "cast(id % 13 as double) as x", "cast(id % 40 + 3 * (id % 13) as double) as y")
    a = run_task(df, "Regression", "Ridge Regression", "y", key_cols=["id"], exclude=["id"])
    monkeypatch.setattr(models, "NORMAL_FEATURES", 1)
    b = run_task(df, "Regression", "Ridge Regression", "y", key_cols=["id"], exclude=["id"])
    assert abs(a.report["rmse"] - b.report["rmse"]) < 1e-6
    one, two = ({r.row_key: r.y_pred for r in res.results.collect()} for res in (a, b))
    assert max(abs(one[k] - two[k]) for k in one) < 1e-5


def test_continuous_classification_target(spark):
    df = spark.range(90).selectExpr("id", "cast(id as double) as x", "(id % 9) / 4.0 as y", "cast(id % 2 as double) as z")
    with pytest.raises(ValueError, match="Unknown label type"):
        run_task(df.drop("z"), "Classification", "Logistic Regression", "y", key_cols=["id"], exclude=["id"])
    assert set(run_task(df.drop("y"), "Classification", "Logistic Regression", "z", key_cols=["id"], exclude=["id"]).report["class_labels"]) <= {"0.0", "1.0"}


# ---------------------------------------------------------------- layout

def _copies(spark):
    hot = spark.range(2000).selectExpr("1.5D as a", "2.5D as b", "'x' as y")
    rest = spark.range(3000).selectExpr("cast(id % 97 as double) as a", "cast(id * 31 % 101 as double) as b", "if(id * 31 % 101 > 50, 'x', 'z') as y")
    return hot.union(rest)


@pytest.mark.parametrize("task,model,target,params", [
    ("Classification", "Random Forest Classifier", "y", {"num_trees": 5, "max_depth": 4}),
    ("Regression", "Random Forest Regressor", "b", {"num_trees": 5, "max_depth": 4}),
    ("Clustering", "KMeans", None, {}),
    ("Anomaly Detection", "Isolation Forest", None, {"iforest_trees": 10, "iforest_max_samples": 64})])
def test_fits_do_not_depend_on_the_layout(spark, task, model, target, params):
    df = _copies(spark)
    seen = set()
    for n in (1, 5, 17):
        res = run_task(df.repartition(n), task, model, target, params=params)
        rows = sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in res.results.collect())
        seen.add(tuple(rows))
        res.release()
    assert len(seen) == 1


# ---------------------------------------------------------------- width

def test_statistics_of_many_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 300))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(300)))
    cols = df.columns
    summary = stats.numeric_summary(df, cols)
    med = stats.exact_medians(df, cols, summary)
    assert all(abs(med[c] - np.median(x[:, i])) < 1e-12 and abs(summary.mean[c] - x[:, i].mean()) < 1e-9 for i, c in enumerate(cols))
    plan = stats.long_numeric(df, cols[:stats.BLOCK_COLUMNS]).groupBy("ci").agg(F.percentile_approx("v", 0.5, 100))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("partial_percentile_approx"):]
    assert "Sort" not in below


def test_order_statistics_over_many_exponents(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([10.0 ** rng.uniform(-300, 300, 4000), -(10.0 ** rng.uniform(-300, 300, 1000)), np.full(50, 7.0)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    ranks = [0, 700, 2500, 3333, 5049]
    got = stats.exact_order_stats(df, {"x": ranks}, bins=16, exact_limit=50)
    assert [got[("x", k)] for k in ranks] == np.sort(x)[ranks].tolist()


def test_scans_are_not_shuffled_by_default(spark, monkeypatch):
    from tessera.sources import parquet

    path = "/root/testdata/sf0.001/lineitem.parquet"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(parquet.read_parquet(spark, path))
    assert "Exchange" in plan(parquet.read_parquet(spark, path, balance=True))
    monkeypatch.setattr(parquet, "BALANCE_BYTES", 10)
    assert "Exchange" not in plan(parquet.read_parquet(spark, path, balance=True))


def test_plot_entries_are_computed_on_access(spark):
    res = run_task(_reg(spark, "x"), "Regression", "Ridge Regression", "y", key_cols=["id"], exclude=["id"])
    assert {type(v).__name__ for v in res.plot.values()} == {"str", "DataFrame"}
    assert dict(res.plot.items())["data"].count() > 0
    res.release()


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    from tessera.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
