from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.plans.tasks import run_task
from test_plans import plan


def points(spark, parts):
    # a third of the rows lie in one cell
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") % 97).cast("double")).alias("x"),
                                  F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") % 89).cast("double")).alias("y"))
    return df.repartition(parts, "x" if parts == 5 else "id")


def sample(df, **kw):
    return sorted(map(tuple, metrics.scatter_sample(df, "x", "y", ["id"], **kw).collect()), key=str)


def test_same_sample_in_any_layout(spark):
    one = sample(points(spark, 1), per_cell=4, bins=10)
    assert one == sample(points(spark, 5), per_cell=4, bins=10) == sample(points(spark, 13), per_cell=4, bins=10)
    assert one != sample(points(spark, 1), per_cell=4, bins=10, seed=7)
    cells = Counter((p[1], p[2]) for p in one)
    grid = {(r.bx, r.by): r.n for r in metrics.grid_counts(points(spark, 1), "x", "y", bins=10).collect()}
    assert cells == {c: min(n, 4) for c, n in grid.items()}


def test_partitions_send_a_bounded_number_of_rows(spark):
    text = plan(metrics.scatter_sample(points(spark, 5), "x", "y", ["id"]), "simple")
    above, below = text.split("Exchange hashpartitioning(bx", 1)
    assert "Final" in above and "WindowGroupLimit" in above and "WindowGroupLimit" in below and "Partial" in below


def test_odd_points(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, "a"), (1, 1.0, 2.0, "a"), (None, 3.0, 2.0, None), (2, None, 1.0, "a"),
                                (3, float("nan"), 1.0, "b")], "id long, x double, y double, group string")
    got = metrics.scatter_sample(df, "x", "y", ["id"], group="group", per_cell=1).collect()
    assert sorted((str(r["group"]), r.x, r.y) for r in got) == [("None", 3.0, 2.0), ("a", 1.0, 2.0)]
    assert metrics.scatter_sample(df.limit(0), "x", "y", ["id"]).count() == 0


def test_points_of_the_tasks(spark):
    df = spark.range(300).selectExpr("id", "cast(id % 17 as double) as a", "cast(id % 5 as double) as b", "id * 2.5D as y")
    run = dict(key_cols=["id"], exclude=["id"])
    for task, model, target in (("Regression", "Ridge Regression", "y"), ("Clustering", "KMeans", None), ("Dimensionality Reduction", "PCA", None)):
        res = run_task(df, task, model, target, **run)
        rows, cells = res.plot["points"].collect(), res.plot["data"].collect()
        assert {(r["group"], r["bx"], r["by"]) for r in rows} == {(r["group"], r["bx"], r["by"]) for r in cells}
        assert len(rows) == sum(min(20, r["n"]) for r in cells)
        res.release()
