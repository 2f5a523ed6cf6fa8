import numpy as np
import pytest

from tessera.operators import stats


def test_median_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert stats.exact_medians(df, ["x"]) == {"x": 2.5}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_order_stats_match_numpy_with_many_passes(spark, seed):
    rng = np.random.default_rng(seed)
    a = np.concatenate([rng.standard_cauchy(3000), np.full(500, 7.25), rng.integers(-5, 5, 700).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in a], "x double").repartition(5)
    s = np.sort(a)
    ks = [0, 1, 999, 2100, 2101, len(a) - 1]
    got = stats.exact_order_stats(df, {"x": ks}, bins=4, exact_limit=20)
    assert [got[("x", k)] for k in ks] == [s[k] for k in ks]
    assert stats.exact_medians(df, ["x"])["x"] == float(np.median(a))


def test_median_all_null_and_constant(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 5.0), (None, 5.0)], "a double, b double")
    summary = stats.numeric_summary(df, ["a", "b"])
    med = stats.exact_medians(df, ["a", "b"], summary)
    assert med == {"a": None, "b": 5.0}
    means, stds = stats.imputed_moments(summary, med)
    assert means == {"b": 5.0} and stds == {"b": 0.0}


def test_imputed_moments_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(10, 3, 1001)
    vals = [None if i % 5 == 0 else float(v) for i, v in enumerate(x)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    summary = stats.numeric_summary(df, ["x"])
    med = stats.exact_medians(df, ["x"], summary)
    nn = np.array([v for v in vals if v is not None])
    assert med["x"] == float(np.median(nn))
    filled = np.array([med["x"] if v is None else v for v in vals])
    means, stds = stats.imputed_moments(summary, med)
    assert abs(means["x"] - filled.mean()) < 1e-9
    assert abs(stds["x"] - filled.std()) < 1e-9


def test_mode_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), (None,)], "c string")
    cs = stats.category_stats(df, ["c"])
    assert cs.mode == {"c": "a"} and cs.categories == {"c": ["a", "b"]} and cs.n_distinct == {"c": 2}


def test_dictionaries_have_no_limit(spark):
    cs = stats.category_stats(spark.range(3000).selectExpr("cast(id as string) as c"), ["c"])
    assert cs.n_distinct == {"c": 3000} and cs.categories["c"] == sorted(map(str, range(3000)))


def test_mode_hot_value_spread_over_partitions(spark):
    df = spark.range(30000).selectExpr("case when id % 3 = 0 then 'hot' else cast(id as string) end as c")
    cs = stats.category_stats(df.repartition(7), ["c"], with_categories=False)
    assert cs.mode == {"c": "hot"} and cs.n_distinct == {"c": 20001}


def test_wrong_bracket_falls_back(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(0, 1, 4001)
    df = spark.createDataFrame([(float(v),) for v in a], "x double")
    got = stats.exact_order_stats(df, {"x": [2000]}, brackets={"x": (5.0, 6.0)})
    assert got[("x", 2000)] == float(np.median(a))
