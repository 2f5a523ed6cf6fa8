import math
from collections import defaultdict

import numpy as np
import pytest

from conftest import SF_SMALL
from tessera.llm import queries, whitening

L = np.longdouble


def basis(d, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0].astype(L)
    for _ in range(4):
        q = q @ (1.5 * np.eye(d, dtype=L) - q.T @ q / 2)
    return q


@pytest.mark.parametrize("values", [
    np.linspace(1, 64, 64), 10.0 ** np.arange(-6, 6), np.r_[1 + 1e-9 * np.arange(5), np.linspace(2, 9, 40)],
    np.r_[1 + 1e-6 * np.arange(3), 1 + 1e-3 + 1e-10 * np.arange(3), 5, 7]])
def test_eigenvectors_of_close_values_to_double_precision(values):
    q, values = basis(len(values)), np.asarray(values, L)
    a = (q * values) @ q.T
    found, x = whitening.eigen((a + a.T) / 2)
    order = np.argsort(-values, kind="stable")
    assert np.abs(found - values[order]).max() <= 1e-15 * values.max()
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-15
    assert (1 - np.abs((q[:, order] * x).sum(axis=0))).max() < 1e-15


@pytest.mark.parametrize("values", [[1] * 6 + [5] * 4 + [7, 9], [0] * 5 + [1, 2, 3], [4] * 8, [0] * 3, []])
def test_equal_values_give_an_orthonormal_basis(values):
    q, values = basis(len(values)) if values else np.zeros((0, 0), L), np.asarray(values, L)
    a = (q * values) @ q.T
    found, x = whitening.eigen(a)
    if len(values):
        assert np.abs(a @ x - x * found).max() < 1e-16 and np.abs(x.T @ x - np.eye(len(values))).max() < 1e-15


def test_float32_alone_would_not_do():
    q, values = basis(40), np.r_[1 + 1e-9 * np.arange(5), np.linspace(2, 9, 35)].astype(L)
    a = (q * values) @ q.T
    low = whitening._low(a)[1]
    assert (1 - np.abs((q * low).sum(axis=0))).max() > 1e-3


def brute(rows, k=8):
    """Usable rows as integers, then numpy in double precision on the exact covariance."""
    ok = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in ok]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    centred = np.array([[n * c - t for c, t in zip(v, s)] for v in x], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [i for i, _ in ok], n, deviation, centred @ vectors[:, :k] / np.sqrt(values[:k]), values / values.sum()


def compare(out, rows, k=8):
    ids, n, deviation, white, share = brute(rows, k)
    assert len(out) == len(ids) * k
    got = defaultdict(list)
    for r in out:
        got[r.component].append(r)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, deviation[i], white[i, 0]))
    for c in range(1, k + 1):
        part = sorted(got[c], key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened))
        assert [(r.vec_id, r.n, int(r.deviation)) for r in part] == [(ids[i], n, deviation[i]) for i in order]
        w, want = np.array([r.whitened for r in part]), white[order, c - 1]
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-9
        assert all(abs(r.explained / share[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in part)


def test_query_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    compare(queries.op11_whitened_embeddings(spark, SF_SMALL).collect(), rows)


def test_odd_vectors_and_layouts(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(np.float32(c)) for c in rng.standard_normal(5) * [9, 7, 5, 3, 1]]) for k in range(60)]
    rows = good + [good[7]] * 30 + [(None, good[9][1])] + [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5),
                                                          (104, [1.0, 2.0, float("-inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as n", "'w' as w", "array(1) as v")
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 5]
    results = []
    for parts in (1, 7):
        out = whitening.whiten(spark, df.repartition(parts)).collect()
        compare(out, kept, 5)
        results.append(sorted((r.vec_id or -1, r.component, r.whitened) for r in out))
    assert results[0] == results[1]


def test_large_entries_stay_exact(spark):
    rows = [(1, [3e7, -1.0]), (2, [-3e7, 2.0]), (3, [1e3, 2.5e8])]
    out = whitening.whiten(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((3 * c - t) ** 2 for c, t in zip(v, s)) for (i, _), v in zip(rows, x)}
    assert {r.vec_id: int(r.deviation) for r in out} == want and all(r.identity_error < 1e-9 for r in out)
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(spark, spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id bigint, embedding array<double>")).collect()


def test_no_variance_and_empty(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(4)], "vec_id bigint, embedding array<float>")
    line = spark.createDataFrame([(k, [1.0 * k, 2.0 * k]) for k in range(4)], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(spark, same).count() == 0 and whitening.whiten(spark, same.where("false")).count() == 0
    assert {r.component for r in whitening.whiten(spark, line).collect()} == {1}
    assert whitening.whiten(spark, same.where("false")).dtypes == whitening.whiten(spark, line).dtypes
