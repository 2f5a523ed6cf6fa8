import math
from collections import Counter

import numpy as np
import pytest
from odd_inputs import low, no_docs, odd_docs, odd_rows  # noqa: F401
from pyspark.sql import functions as F

from tessera.llm import maxent as M


def tokens(text):
    return low(text).encode().split() + [b"\n"]


@pytest.mark.parametrize("frequent", [131_072, 20])
def test_base_score_against_brute_force(spark, odd_docs, odd_rows, frequent, monkeypatch):
    monkeypatch.setattr(M, "FREQUENT", frequent)  # the small bound joins nearly all words
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    c = Counter(w for d, t in odd_rows if d is not None and d % 3 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for d, t in odd_rows)
    rows = M.score(spark, odd_docs, train).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_probabilities_sum_to_one():
    random = np.random.default_rng(0)
    model = M.Model(random.normal(size=(M.CLASSES, M.FEATURES)).astype(np.float32), random.normal(size=(M.MEMBERS, M.FEATURES * M.CLASSES)).astype(np.float32))
    f = np.repeat(random.integers(1, M.FEATURES, (M.USED, 1)), M.BUCKETS, axis=1).astype(np.uint16)
    assert abs((10 ** M.log_probability(model, f, np.arange(M.BUCKETS))).sum() - 1) < 1e-4


def test_training_lowers_the_loss():
    random = np.random.default_rng(0)
    f = random.integers(1, 50, (M.USED, 20_000)).astype(np.uint16)
    bucket = (f[0].astype(np.int64) * 5) % M.BUCKETS
    model = M.Model.empty()
    squares = np.zeros(model.first.shape[1], np.float32), np.zeros(model.second.shape[1], np.float32)
    before = M.log_probability(model, f, bucket).mean()
    for at in range(0, len(bucket), 500):
        M.train_batch(model, squares, f[:, at:at + 500], bucket[at:at + 500])
    assert M.log_probability(model, f, bucket).mean() > before / 2


@pytest.mark.parametrize("back", [2, 3])
def test_both_steps_learn_from_either_skip(back):
    random = np.random.default_rng(0)
    n = 20_000
    key = random.integers(0, 1 << 62, 1000)[random.integers(0, 1000, (n, back + 1))]  # texts of back + 1 words
    told = random.integers(0, 200, n)
    key[:, 0] = np.arange(200)[told] + (1 << 40)  # the first word alone tells the last one's bucket
    f = M.features(key.ravel(), np.full(n, back + 1))[:, back::back + 1]
    bucket = told * 37 % M.BUCKETS
    model = M.Model.empty()
    squares = np.zeros(model.first.shape[1], np.float32), np.zeros(model.second.shape[1], np.float32)
    for at in range(0, n // 2, 500):
        M.train_batch(model, squares, f[:, at:at + 500], bucket[at:at + 500])
    bucket = bucket[n // 2:]  # texts that were not trained on
    _, p, q = M._probabilities(model, f[:, n // 2:], bucket)
    at = np.arange(len(bucket))
    assert np.log10(p[bucket // M.MEMBERS, at]).mean() > -0.5 and np.log10(q[bucket % M.MEMBERS, at]).mean() > -0.5


def test_contexts_do_not_cross_texts():
    key = np.arange(100, 108)
    f = M.features(key, np.array([4, 4]))
    assert np.array_equal(f[:, :4], M.features(key[:4], np.array([4])))
    assert np.array_equal(f[:, 4:], M.features(key[4:], np.array([4])))


def test_hashes_name_the_words(odd_rows, monkeypatch):
    texts = [t for _, t in odd_rows]
    for step in (1 << 20, 64):
        monkeypatch.setattr(M, "STEP_BYTES", step)
        key, ending, sizes = M.Hasher().tokens(texts)
        words = [w for t in texts for w in tokens(t)]
        assert sizes.tolist() == [len(tokens(t)) for t in texts] and len(key) == len(words)
        of = {}
        for w, k, e in zip(words, key.tolist(), ending.tolist()):
            assert of.setdefault(w, (k, e)) == (k, e)
        assert len({k for k, _ in of.values()}) == len(of)


def test_frequent_table_finds_all_and_nothing_else():
    random = np.random.default_rng(1)
    key = random.integers(-(1 << 63), 1 << 63, 50_000)
    key[:3000] = (key[:3000] & ((1 << 40) - 1)) | (7 << 45)  # a crowd in one place
    key = np.unique(key)
    table = M.Frequent(key, np.arange(len(key)), np.arange(len(key)))
    assert np.array_equal(table.find(key), np.arange(len(key)))
    other = np.setdiff1d(random.integers(-(1 << 63), 1 << 63, 50_000), key)
    assert (table.find(other) == -1).all()


def test_bounded_memory_of_words(spark, odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(M, "REMEMBERED", 10)
    counts = Counter(r.c for r in M.count_words(odd_docs, "text").collect())
    assert counts == Counter(Counter(w for _, t in odd_rows for w in tokens(t)).values())


def test_model_beats_the_base_on_held_out_texts(spark):
    from tessera.llm.queries import QUERIES

    rows = QUERIES["op9_maxent_scores"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_no_training_rows_and_empty_table(spark, odd_docs, no_docs):
    rows = M.score(spark, odd_docs, F.lit(False)).collect()
    assert len(rows) == odd_docs.count() and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
    assert M.score(spark, no_docs, F.lit(True)).count() == 0


def test_weights_of_a_feature_lie_together():
    """A feature's weights are gathered and stepped as one line of memory (before: one stride for each output),
    also after a copy; the steps are those of weights held the other way round."""
    random = np.random.default_rng(9)
    f = random.integers(1, M.FEATURES, (M.USED, 900)).astype(np.uint16)
    bucket = random.integers(0, M.BUCKETS, 900)
    held = M.Model.empty()
    other = M.Model(np.zeros(held.first.shape, np.float32), np.zeros(held.second.shape, np.float32))
    for model in (held, other):
        squares = np.zeros(model.first.shape[1], np.float32), np.zeros(model.second.shape[1], np.float32)
        for at in range(0, 900, 300):
            M.train_batch(model, squares, f[:, at:at + 300], bucket[at:at + 300])
    assert held.first[:, 5].flags.c_contiguous and held.second[:, 5].flags.c_contiguous
    assert np.array_equal(held.first, other.first) and np.array_equal(held.second, other.second)
    assert held.first.any() and np.array_equal(M.log_probability(held, f, bucket), M.log_probability(other, f, bucket))
