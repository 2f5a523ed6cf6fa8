"""Property tests (hypothesis): exact statistics and split counts against brute force."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.operators.split import exact_split, with_row_key

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

values = st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=300)


@SETTINGS
@given(vals=values, parts=st.integers(1, 6))
def test_median_matches_numpy(spark, vals, parts):
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(parts)
    nn = np.array([v for v in vals if v is not None])
    summary = stats.numeric_summary(df, ["x"])
    got = stats.exact_medians(df, ["x"], summary)["x"]
    if len(nn) == 0:
        assert got is None
    else:
        assert got == float(np.median(nn))
        ks = sorted({0, len(nn) // 3, len(nn) - 1})
        found = stats.exact_order_stats(df, {"x": ks}, summary, bins=3, exact_limit=4)
        s = np.sort(nn)
        assert [found[("x", k)] for k in ks] == [s[k] for k in ks]


@SETTINGS
@given(n=st.integers(2, 400), dups=st.integers(0, 200), size=st.floats(0.01, 0.9), seed=st.integers(0, 10**6))
def test_split_count_is_exact(spark, n, dups, size, seed):
    rows = [(i,) for i in range(n)] + [(-1,)] * dups
    total = n + dups
    if math.ceil(size * total) >= total:
        return
    df = with_row_key(spark.createDataFrame(rows, "v long").repartition(3))
    out = exact_split(df, size, seed)
    assert out.where("is_test").count() == math.ceil(size * total)
    assert out.count() == total


def test_kmeans_rows_sit_at_nearest_centre(spark):
    from tessera.operators import models as M
    from tessera.plans.tasks import run_task

    rng = np.random.default_rng(11)
    pts = rng.normal(0, 1, (400, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, a double, b double, c double")
    res = run_task(df, "Clustering", "KMeans", None, key_cols=["id"], exclude=["id"])
    pipe = res.model.stages[-1]
    km, relabel = pipe.stages[0], pipe.stages[1]
    centres = np.array([c for c in km.clusterCenters()])
    mapping = relabel.getOrDefault(relabel.mapping)
    feats = res.model.stages[0].transform(df.withColumn("row_key", F.col("id").cast("string")))
    x = np.array([r["f"] for r in feats.select(vector_to_array(M.FEATURES).alias("f")).collect()])
    ids = [r["id"] for r in feats.select("id").collect()]
    nearest = {i: mapping[int(np.argmin(((centres - v) ** 2).sum(1)))] for i, v in zip(ids, x)}
    got = {r["id"]: r["cluster"] for r in res.results.collect()}
    assert got == nearest
    assert sum(res.report["cluster_counts"].values()) == 400
    res.release()
