"""Forests of many trees, grown from sums by cell."""

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tessera.operators import forest
from tessera.operators import models as M
from tessera.plans.tasks import run_task


def table(spark, n=600, values=6, classes=False):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, values, n).astype(float), rng.integers(0, 5, n).astype(float)
    y = np.where(a > values // 2, 10.0, 0.0) + b * b + rng.normal(0, 0.3, n)
    rows = [(i, float(p), float(q), str(int(v + 3) // 8) if classes else float(v)) for i, (p, q, v) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, y " + ("string" if classes else "double"))


def run(df, classes=False, **params):
    task, model = ("Classification", "Random Forest Classifier") if classes else ("Regression", "Random Forest Regressor")
    return run_task(df, task, model, "y", key_cols=["id"], exclude=["id"], params={"num_trees": 100, **params})


def predictions(res):
    return sorted((r["row_key"], r["y_pred"]) for r in res.results.collect())


def by_rows(x, y, w, depth, max_depth):
    """A tree from single rows with their counts: best variance gain over all midpoints, ties to the first."""
    mean = np.average(y, weights=w)
    best = (1e-12, None, None)
    for f in range(x.shape[1]):
        for t in forest.midpoints(np.unique(x[:, f])):
            left = x[:, f] <= t
            m = [np.average(y[s], weights=w[s]) for s in (left, ~left)]
            gain = sum(w[s].sum() * (v - mean) ** 2 for s, v in zip((left, ~left), m)) / w.sum()
            if gain > best[0] * (1 + 1e-9):
                best = (gain, f, t)
    if depth == max_depth or best[1] is None:
        return [(len(y), mean)]
    left = x[:, best[1]] <= best[2]
    return [leaf for s in (left, ~left) for leaf in by_rows(x[s], y[s], w[s], depth + 1, max_depth)]


@pytest.mark.parametrize("max_depth", [1, 2, 30])
def test_tree_from_sums_is_the_tree_from_rows(max_depth):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 5, (200, 2)).astype(float), rng.normal(0, 1, 200)
    w = forest.bootstrap_counts(rng, 200, 1)[:, 0].astype(float)
    thresholds = [forest.midpoints(np.unique(x[:, f])) for f in range(2)]
    cells, place = np.unique(forest.cell_codes(x, thresholds), return_inverse=True)
    rows = forest.grow_tree(forest.cell_bins(cells, thresholds), np.bincount(place, w), np.bincount(place, w * y)[:, None],
                            thresholds, max_depth, 2, rng)
    leaves = sorted(r[5][0] for r in rows if r[3] < 0)
    want = sorted(v for _, v in by_rows(x[w > 0], y[w > 0], w[w > 0], 0, max_depth))
    assert np.allclose(leaves, want)


def test_bootstrap_counts_are_poisson():
    got = forest.bootstrap_counts(np.random.default_rng(3), 4000, 250)
    assert got.shape == (4000, 250) and got.min() == 0
    share = np.bincount(got.ravel(), minlength=4) / got.size
    assert np.allclose(share[:4], np.exp(-1) / np.array([1, 1, 2, 6]), atol=0.002)
    assert abs(got.mean() - 1) < 0.005 and abs(got.var() - 1) < 0.01


@pytest.mark.parametrize("classes", [False, True])
def test_many_trees_keep_no_count_by_row(spark, monkeypatch, classes):
    """the library's fit, with its counts by row and tree, is not called; another layout gives the same forest."""
    def refused(*_):
        raise AssertionError("the library's forest was fitted")

    monkeypatch.setattr(M.RandomForestRegressor, "fit", refused)
    monkeypatch.setattr(M.RandomForestClassifier, "fit", refused)
    df, outs = table(spark, classes=classes), []
    for d in (df.repartition(1), df.repartition(7)):
        res = run(d, classes)
        assert res.model.stages[1].nodes["tree"].nunique() == 100
        outs.append(predictions(res))
        score = res.report["accuracy"] if classes else res.report["r2"]
        assert score > 0.95
        res.release()
    assert outs[0] == outs[1]


def test_quantile_bins_agree_with_the_library(spark):
    df = table(spark, n=1500, values=400)
    own, lib = run(df), run(df, library_trees=100)
    assert isinstance(own.model.stages[1], forest.CellForestModel) and not isinstance(lib.model.stages[1], forest.CellForestModel)
    assert abs(own.report["r2"] - lib.report["r2"]) < 0.02
    a, b = (np.array([p for _, p in predictions(r)]) for r in (own, lib))
    assert np.corrcoef(a, b)[0, 1] > 0.99
    own.release(), lib.release()


def test_too_many_cells_are_the_librarys(spark, monkeypatch):
    monkeypatch.setattr(forest, "MOST_SUMS", 100 * 29)  # the table has 30 cells
    res = run(table(spark))
    assert not isinstance(res.model.stages[1], forest.CellForestModel) and res.report["r2"] > 0.95
    res.release()


@pytest.mark.parametrize("classes", [False, True])
def test_constant_features_and_one_class(spark, classes):
    y = F.lit("only") if classes else F.col("id").cast("double")
    df = spark.range(40).select("id", F.lit(2.0).alias("a"), y.alias("y"))
    res = run(df, classes)
    assert len({p for _, p in predictions(res)}) == 1
    res.release()


@pytest.mark.parametrize("classes", [False, True])
def test_save_and_load(spark, tmp_path, classes):
    res = run(table(spark, classes=classes), classes)
    model = res.model.stages[1]
    model.write().overwrite().save(str(tmp_path / "forest"))
    again = forest.CellForestModel.load(str(tmp_path / "forest"))
    feats = res.model.stages[0].transform(table(spark, classes=classes).withColumn(M.ROW_KEY, F.col("id").cast("string")))
    cols = [M.PREDICTION, *(["__prob"] if classes else [])]
    assert model.transform(feats).select("id", *cols).sort("id").collect() == again.transform(feats).select("id", *cols).sort("id").collect()
    if classes:
        probs = np.array([r["__prob"].toArray() for r in model.transform(feats).collect()])
        assert np.allclose(probs.sum(axis=1), 1)
    res.release()
