"""Dictionaries beyond the driver's limit."""
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as Classic

from tessera.operators import stats
from tessera.operators.dictionary import ranked
from tessera.operators.prep import fit_preprocessor
from tessera.plans.tasks import run_task


@pytest.fixture(scope="module")
def mixed(spark):
    random.seed(9)
    rows = [(k, random.gauss(0, 1) if k % 11 else None, random.choice(["a", "b", None]), f"v{random.randint(0, 700)}" if k % 3 else "hot",
             random.choice(["é", "x|y", "", "x_y", None]), float(k % 7)) for k in range(2000)]
    return spark.createDataFrame(rows, "id long, x double, c string, wide string, odd string, y double").repartition(6).cache()


@pytest.fixture
def no_values_on_driver(monkeypatch):
    """Fails if texts of a dictionary are brought to the driver."""
    for name in ("toPandas", "collect", "toLocalIterator"):
        def guarded(self, *a, f=getattr(Classic, name), **b):
            assert "value" not in self.columns, self.columns
            return f(self, *a, **b)

        monkeypatch.setattr(Classic, name, guarded)


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_ranks_are_dense_and_sorted(spark, mixed, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = ranked(stats.value_counts_long(mixed, ["wide", "c", "odd"])).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for c in ("wide", "c", "odd"):
        values = sorted({r[c] for r in mixed.select(c).collect()} - {None})
        assert [(r.idx, r.value) for r in sorted((r for r in rows if r.column == c), key=lambda r: r.idx)] == list(enumerate(values))


def test_empty_dictionary(spark, mixed):
    assert ranked(stats.value_counts_long(mixed.where("false"), ["c"])).count() == 0


def _vectors(model, df, key="id"):
    return {r[key]: r["features"].toArray().tolist() for r in model.transform(df).select(key, "features").collect()}


@pytest.mark.parametrize("levels", [0, 2, 10])
def test_joined_encoding_equals_the_one_on_the_driver(spark, mixed, levels, tmp_path):
    whole, info = fit_preprocessor(mixed, ["x"], ["c", "wide", "odd"])
    joined, own = fit_preprocessor(mixed, ["x"], ["c", "wide", "odd"], driver_levels=levels)
    assert own.feature_names is None and "wide" not in own.categories and own.width == info.width
    assert own.modes == info.modes and abs(own.mean_variance - info.mean_variance) < 1e-12
    names = {r.i: r.feature for r in own.features(spark).collect()}
    assert [names[i] for i in range(own.width)] == info.feature_names
    unseen = spark.createDataFrame([(5000, 1.0, "new", "new", None, 0.0)], mixed.schema)
    df = mixed.union(unseen)
    want = _vectors(whole, df)
    assert _vectors(joined, df) == want
    joined.write().overwrite().save(str(tmp_path / "m"))
    assert _vectors(PipelineModel.load(str(tmp_path / "m")), df) == want


def test_no_dictionary_text_reaches_the_driver(mixed, no_values_on_driver):
    model, info = fit_preprocessor(mixed, ["x"], ["wide"], driver_levels=5)
    assert model.transform(mixed).count() == mixed.count() and info.width == 1 + info.dictionary.count()


def test_schema_does_not_list_the_levels(mixed):
    model, _ = fit_preprocessor(mixed, [], ["wide"], driver_levels=0)
    assert not model.transform(mixed).schema["features"].metadata


@pytest.mark.parametrize("task, model, target, report", [
    ("Regression", "Ridge Regression", "y", "rmse"), ("Dimensionality Reduction", "PCA", None, "explained_variance_ratio"),
    ("Clustering", "KMeans", None, "k")])
def test_tasks_beyond_the_limit(mixed, task, model, target, report):
    df = mixed.select("id", "x", "c", F.substring("wide", 1, 2).alias("wide"), "y")
    a, b = (run_task(df, task, model, target=target, key_cols=["id"], exclude=["id"], params=p) for p in ({}, {"driver_levels": 1}))
    got, want = b.report[report], a.report[report]
    assert got == pytest.approx(want, rel=1e-6)
    assert b.results.count() == a.results.count()
    a.release()
    b.release()
