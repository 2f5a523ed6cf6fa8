import zlib

import numpy as np
import pytest
from odd_inputs import no_docs, odd_docs, odd_rows  # noqa: F401

from tessera.llm import quality as Q
from tessera.llm.common import load
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_dual_coordinate_descent_reaches_the_optimum():
    random = np.random.default_rng(0)
    x = random.normal(size=(60, 5))
    y = np.where(x @ random.normal(size=5) + 0.3 * random.normal(size=60) > 0, 1, -1)
    f = np.arange(5)
    w = Q.dual_coordinate_descent([(f, v) for v in x], y, 5, cost=0.5, epochs=2000)
    best, step = w.copy(), 0.5

    def loss(w):
        return w @ w / 2 + 0.5 * np.maximum(0, 1 - y * (x @ w)).sum()

    for k in range(4000):  # subgradient descent from the result finds nothing better
        best = best - step / (k + 10) * (best - 0.5 * ((y * (x @ best) < 1) * y) @ x)
        assert loss(best) > loss(w) - 1e-2


def test_features_are_distinct_and_cover_the_whole_text():
    grams = Q.Grams()
    f = grams("abcd abcd abcd zzzz")
    assert len(set(f.tolist())) == len(f) and f.max() < Q.FEATURES
    long = "ab cd " * 50_000
    assert set(grams(long + "#*$%")) - set(grams(long))
    assert len(grams("")) == len(grams(None)) and grams("").tolist() == grams(None).tolist()


def test_log_count_ratios(spark):
    rows = [("aaaa", 1), ("aaaa bbbb", 1), ("bbbb", 0), (None, 0)]
    ratio, sizes = Q.log_count_ratios(spark.createDataFrame(rows, "t string, y int"), "t", "y")
    n = np.ones((2, Q.FEATURES))
    grams = Q.Grams()
    for t, y in rows:
        n[y, grams(t)] += 1
    n /= n.sum(axis=1, keepdims=True)
    assert sizes == (2, 2) and np.allclose(ratio, np.log(n[1] / n[0]))


def test_held_out_accuracy(spark):
    got = QUERIES["op1_quality_classifier"](spark, SF)
    rows = got.join(load(spark, SF, "labels", "doc_id", "quality"), "doc_id").collect()
    assert got.count() == load(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.95


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_odd_inputs(spark, odd_docs, broadcast, monkeypatch):
    monkeypatch.setattr(Q, "BROADCAST_LABELS", broadcast)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 240)] + [(None, 1), (7, None), (8, 5)], "doc_id bigint, quality int")
    model = Q.fit(spark, odd_docs, labels)
    out = odd_docs.select("doc_id", "text", Q.score(spark, model, odd_docs["text"]).alias("s")).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.s <= 1 for r in out)
    assert len({r.s for r in out if not r.text}) == 1  # null and empty texts alike
    kept = Q.keep_good(spark, odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() <= len(out)


def test_one_class_and_empty_tables(spark, odd_docs, no_docs):
    ones = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id bigint, quality int")
    assert Q.keep_good(spark, odd_docs, ones).count() == odd_docs.count()
    none = ones.where("false")
    model = Q.fit(spark, odd_docs, none)
    assert model.score(Q.Grams()("text")) == 0.5
    assert Q.keep_good(spark, no_docs, none).count() == 0
