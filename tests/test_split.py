import math

import pytest
from pyspark.sql import functions as F

from tessera.operators.split import exact_split, n_test_rows, with_row_key


def test_n_test_is_unrounded_ceil():
    assert n_test_rows(100, 0.07) == 8
    assert n_test_rows(100, 0.55) == 56
    assert n_test_rows(15000, 0.2) == 3000


@pytest.mark.parametrize("size", [0.05, 0.2, 0.5, 0.95])
def test_exact_count(spark, size):
    df = with_row_key(spark.range(1003).withColumnRenamed("id", "k"), ["k"])
    out = exact_split(df, size, 42)
    assert out.where("is_test").count() == math.ceil(size * 1003)
    assert out.count() == 1003


def test_stable_under_repartition(spark):
    base = with_row_key(spark.range(2000).withColumnRenamed("id", "k"), ["k"])
    sets = []
    for n in (1, 4, 17):
        out = exact_split(base.repartition(n), 0.2, 7)
        sets.append({r["k"] for r in out.where("is_test").collect()})
    assert sets[0] == sets[1] == sets[2] and len(sets[0]) == 400


def test_seed_changes_the_set(spark):
    base = with_row_key(spark.range(500).withColumnRenamed("id", "k"), ["k"])
    a = {r["k"] for r in exact_split(base, 0.2, 1).where("is_test").collect()}
    b = {r["k"] for r in exact_split(base, 0.2, 2).where("is_test").collect()}
    assert a != b and len(a) == len(b) == 100


def test_duplicate_rows_get_exact_count(spark):
    df = with_row_key(spark.createDataFrame([(1, "x")] * 10, "a int, b string"))
    out = exact_split(df, 0.3, 42)
    assert out.where("is_test").count() == 3 and out.count() == 10


def test_hot_duplicate_group(spark):
    # a third of the rows are copies of one row; the rest are distinct
    hot = spark.range(3000).select(F.lit(-1).cast("long").alias("v"))
    rest = spark.range(6000).select(F.col("id").alias("v"))
    df = with_row_key(hot.union(rest).repartition(6))
    for size in (0.1, 0.3, 0.77):
        out = exact_split(df, size, 42)
        assert out.where("is_test").count() == math.ceil(size * 9000)
        assert out.count() == 9000


def test_empty_input(spark):
    df = with_row_key(spark.range(0).withColumnRenamed("id", "k"), ["k"])
    with pytest.raises(ValueError, match="empty"):
        exact_split(df, 0.2, 42)


@pytest.mark.parametrize("limit", [100_000, 10])
def test_cut_equals_a_sort_in_one_aggregate(spark, monkeypatch, limit):
    from tessera.operators import split

    passes = []
    rows, limited = split._rows, limit == 10
    monkeypatch.setattr(split, "EXACT_LIMIT", limit)
    monkeypatch.setattr(split, "_rows", lambda hist: passes.append(1) or rows(hist))
    for n, keys in ((1, 1), (2, 2), (5, 5), (3000, 3000), (3000, 7), (4000, 900)):
        hashed = spark.range(n).select(F.md5((F.col("id") % keys).cast("string")).alias(split.HASH)).cache()
        ordered = sorted(r[0] for r in hashed.collect())
        for k in {1, max(1, n // 5), max(1, n // 2), max(1, n - 1)}:
            passes.clear()
            t = ordered[k - 1]
            want = (t, sum(h < t for h in ordered), ordered.count(t))
            assert split.find_cut_near(hashed, n, k) == want == split.find_cut(hashed, k)
            if n == keys and not limited:
                passes.clear()
                split.find_cut_near(hashed, n, k)
                assert len(passes) == 1
        hashed.unpersist()
