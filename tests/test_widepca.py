"""Principal components without a covariance matrix (M7, M8)."""
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators import models as M
from tessera.operators import widepca
from tessera.operators.widepca import principal_components
from tessera.plans.tasks import run_task
from tessera.sinks import save_model


@pytest.fixture(scope="module")
def wide(spark):
    """Two related numbers, a text column of 400 levels and one of few, a third of the rows alike."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        a = 0.0 if i % 3 == 0 else float(rng.normal())
        level = "hot" if i % 3 == 0 else f"k{int(rng.integers(400))}"
        rows.append((i, a, 0.5 * a + float(rng.normal()), level, "xyz"[int(rng.integers(3))]))
    return spark.createDataFrame(rows, "id long, a double, b double, level string, c string").repartition(5).cache()


def _task(df, **params):
    return run_task(df, "Dimensionality Reduction", "PCA", None, key_cols=["id"], exclude=["id"], params={"components": 3, **params})


@pytest.fixture(scope="module")
def power(wide):
    res = _task(wide, matrix_features=10)
    yield res
    res.release()


def _scores(res):
    return {r["id"]: (r["pc1"], r["pc2"], r["pc3"]) for r in res.results.collect()}


def test_wide_one_hot_equals_the_covariance_matrix(wide, power):
    whole = _task(wide)
    assert not any(type(s).__name__ == "PCAModel" for s in power.model.stages[-1].stages)
    assert power.report["explained_variance_ratio"] == pytest.approx(whole.report["explained_variance_ratio"], rel=1e-9)
    want, got = _scores(whole), _scores(power)
    assert got.keys() == want.keys() and max(abs(x - y) for i in want for x, y in zip(want[i], got[i])) < 1e-6
    whole.release()


def test_joined_vectors_and_another_layout(wide, power, monkeypatch):
    monkeypatch.setattr(principal_components, "__defaults__", (*principal_components.__defaults__[:-1], 0))
    joined = _task(wide.repartition(17, "c"), matrix_features=10)
    want, got = _scores(power), _scores(joined)
    assert max(abs(x - y) for i in want for x, y in zip(want[i], got[i])) < 1e-6
    joined.release()


def _vectors(spark, rows):
    return spark.createDataFrame([(v,) for v in rows], [M.FEATURES])


def test_close_eigenvalues_and_mixed_vectors(spark):
    """A slowly falling spectrum; dense and sparse rows, a feature that is always zero, means far from zero."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 120)) * np.linspace(1.0, 0.2, 120) + 5
    x[:, 7] = 0
    feats = _vectors(spark, [Vectors.dense(r) if i % 2 else Vectors.sparse(120, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(x)])
    loadings, values, shares, centre = principal_components(feats.repartition(4), M.FEATURES, 2)
    e, u = np.linalg.eigh(np.cov(x.T))
    assert values == pytest.approx(e[::-1][:2], rel=1e-9) and shares == pytest.approx(e[::-1][:2] / e.sum(), rel=1e-9)
    rows = loadings.toPandas().set_index("i")
    for j in range(2):
        v = np.zeros(120)
        v[rows.index] = rows[f"v{j}"]
        assert abs(abs(v @ u[:, -1 - j]) - 1) < 1e-10 and centre[j] == pytest.approx(x.mean(0) @ v, abs=1e-8)


def test_equal_eigenvalues_span_their_space(spark):
    x = np.vstack([np.eye(40)] * 5)  # one-hot, every level as frequent: 39 equal eigenvalues
    _, values, shares, _ = principal_components(_vectors(spark, [Vectors.dense(r) for r in x]), M.FEATURES, 2)
    assert values == pytest.approx([5 / 199] * 2, rel=1e-9) and shares == pytest.approx([1 / 39] * 2, rel=1e-9)


@pytest.mark.parametrize("rows", [[], [[1.0, 2.0, 3.0]], [[1.0, 2.0, 3.0]] * 4, [[0.0, 0.0, 0.0]] * 4])
def test_without_spread(spark, rows):
    feats = spark.createDataFrame([(Vectors.dense(r),) for r in rows] or [(Vectors.dense([0.0]),)], [M.FEATURES])
    if not rows:
        feats = feats.limit(0)
    loadings, values, shares, _ = principal_components(feats, M.FEATURES, 2)
    assert shares == pytest.approx([0.0, 0.0], abs=1e-9) and loadings.columns == ["i", "v0", "v1"]


def test_fewer_dimensions_than_components(spark):
    rows = [Vectors.dense([float(i), 2.0 * i, 0.0]) for i in range(10)]
    loadings, values, shares, _ = principal_components(_vectors(spark, rows), M.FEATURES, 3)
    assert shares == pytest.approx([1.0, 0.0, 0.0], abs=1e-9) and loadings.count() == 2


def test_saved_and_applied(wide, power, tmp_path):
    save_model(power.model, str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(wide).select("id", "pc1", "pc2", "pc3")
    assert {r["id"]: (r["pc1"], r["pc2"], r["pc3"]) for r in again.collect()} == _scores(power)


def test_sign(spark):
    table = spark.createDataFrame([(0, 0.5), (1, -2.0), (2, 2.0)], "i int, v0 double")
    assert widepca.leading_sign(table, "v0") == -1.0 and widepca.leading_sign(table.select("i", F.lit(0.0).alias("v0")), "v0") == 1.0
