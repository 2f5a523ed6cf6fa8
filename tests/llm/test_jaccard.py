import random
import re
from collections import Counter

import numpy as np
import pytest

from conftest import SF_SMALL
from odd_inputs import low, no_docs, odd_docs, odd_rows  # noqa: F401
from tessera.llm import jaccard, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(low(text))
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())


def brute(rows, at=85):
    """All pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= at * len(x | y):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def found(df):
    return Counter(map(tuple, df.collect()))


def altered(words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        words[random.randrange(len(words))] = random.choice(vocabulary)
    return words


@pytest.fixture(scope="module")
def groups():
    """Near copies in chains and stars of many sizes and lengths, texts that share a passage, one passage in a third of all."""
    random.seed(11)
    vocabulary = ["w%d" % k for k in range(3000)]
    texts = []
    for length in (7, 8, 9, 12, 20, 50, 120, 400):
        for group in (2, 3, 12, 40):
            base = random.choices(vocabulary, k=length)
            for k in range(group):
                base = altered(base, 1, vocabulary) if group == 12 else base
                texts.append(altered(base, random.randint(0, 1 + length // 25), vocabulary))
    hot = random.choices(vocabulary, k=60)
    for k in range(150):
        own = random.choices(vocabulary, k=random.randint(3, 200))
        texts.append(own + hot if k % 2 else own)
    texts += [random.choices(["a", "b"], k=random.randint(4, 30)) for _ in range(60)]
    rows = [(k * 7 % 1009, " ".join(t)) for k, t in enumerate(texts)]
    random.shuffle(rows)
    return rows


def test_shingles_and_sizes_of_sets(odd_rows):
    s = jaccard.Shingles(4)
    for _, t in odd_rows:
        assert len(s.tokens(jaccard.words_of(t))) == len(shingles(t))
    assert s.tokens([b"a", b"b"])[0] != s.tokens([b"b", b"a"])[0] and s.tokens([b"a"])[0] != s.tokens([b"a", b"a"])[0]


@pytest.mark.parametrize("at", [85, 80, 50])
def test_linked_sets_share_an_entry_whatever_is_frequent(at):
    """The prefix rule itself, with random tokens declared frequent: no pair at the threshold is lost."""
    rng = np.random.default_rng(at)
    rule = jaccard.Rule(at, 100)
    for _ in range(600):
        n = int(rng.integers(6, 400))
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        gone, new = (int(v) for v in rng.integers(0, rule.lacking(n) + 1, 2))
        y = np.r_[x[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)]
        if not rule.links(len(x), len(y), n - gone):
            continue
        share = rng.choice([0, 0.2, 0.6, 0.9, 1.0])
        entries = []
        for t in (np.unique(x), np.unique(y)):
            frequent = (jaccard._mix(t) % np.uint64(1000)) < share * 1000
            band = t < jaccard._END
            own = set(t[band & ~frequent].tolist())
            if len(own) <= rule.lacking(len(t)):
                own |= set(t[~frequent].tolist())
            if (~frequent).sum() <= rule.lacking(len(t)):
                own |= set(rule.pairs(len(t), t[frequent]).tolist())
            entries.append(own)
        assert entries[0] & entries[1]


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(2)
    for _ in range(500):
        n = int(rng.integers(1, 3000))
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        gone, new = (int(v) for v in rng.integers(0, n // int(rng.choice([1, 20])) + 1, 2))
        y = np.r_[x[gone:], rng.integers(0, 2**64, new + (gone == n), dtype=np.uint64)]
        by = jaccard.differ_at_least(jaccard.sketch(x), jaccard.sketch(y))
        assert by <= len(set(x.tolist()) ^ set(y.tolist()))
        rule = jaccard.Rule(85, 100)
        if rule.links(len(x), len(y), n - gone):
            assert rule.may_differ(len(x), len(y), by)


@pytest.mark.parametrize("few, chunk, short", [(8, 1 << 20, 128), (1, 200, 0)])
def test_odd_documents_against_all_pairs(spark, odd_docs, odd_rows, few, chunk, short, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    assert found(jaccard.similar_documents(spark, odd_docs)) == brute(odd_rows)


@pytest.mark.parametrize("few, at", [(8, 85), (2, 85), (3, 60)])
def test_groups_against_all_pairs(spark, groups, few, at, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "PIVOTS", (2, 3) if few == 3 else (8, 64, 256))
    docs = spark.createDataFrame(groups, "doc_id bigint, text string").repartition(7)
    assert found(jaccard.similar_documents(spark, docs, at=at)) == brute(groups, at)


def test_many_candidates_are_joined_without_broadcast(spark, groups, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame(groups, "doc_id bigint, text string")
    assert found(jaccard.similar_documents(spark, docs)) == brute(groups)


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert found(queries.op13_jaccard_groups(spark, SF_SMALL)) == brute(rows)


def test_empty_table(spark, no_docs):
    assert jaccard.similar_documents(spark, no_docs).count() == 0


def test_blocks_keep_every_possible_pair():
    import pyarrow as pa

    rule, r = jaccard.Rule(85, 100), random.Random(5)
    base = [r.getrandbits(64) for _ in range(140)]
    sets = [np.unique(np.array(base[:r.randint(100, 140)] + [r.getrandbits(64) for _ in range(r.randint(0, 30))], np.uint64)) for _ in range(60)]

    def block(nodes):
        bits = [jaccard.sketch(sets[i]).tobytes() for i in nodes]
        return pa.StructArray.from_arrays([pa.array(nodes), pa.array([len(sets[i]) for i in nodes]), pa.array([i % 7 for i in nodes]), pa.array(bits)],
                                          names=["node", "n", "root", "bits"])

    members, pivots = list(range(40)), list(range(30, 60))
    want = {(i, j) for i in members for j in pivots if i % 7 != j % 7 and rule.near(len(sets[i]), len(sets[j]))
            and rule.may_differ(len(sets[i]), len(sets[j]), jaccard.differ_at_least(jaccard.sketch(sets[i]), jaccard.sketch(sets[j])))}
    assert len({len(jaccard.sketch(s)) for s in sets}) > 1 and 0 < len(want) < 900
    assert set(zip(*(x.tolist() for x in jaccard.block_pairs(block(members), block(pivots), rule)))) == want


def test_rounds_of_a_cell_are_logarithmic(spark, monkeypatch):
    """900 unlinked sets of one entry: pivots of 8, 64 and then all of them (before: 256 a round)."""
    r = np.random.default_rng(3)
    sets = spark.createDataFrame([(i, 40, jaccard.sketch(r.integers(0, 2**63, 40).astype(np.uint64)).tobytes()) for i in range(900)], "node long, n long, bits binary")
    opened = []
    real = jaccard._Connecting.open
    monkeypatch.setattr(jaccard._Connecting, "open", lambda self, rows, group: opened.append(group) or real(self, rows, group))
    monkeypatch.setattr(jaccard, "BLOCK", 1 << 12)
    c = jaccard._Connecting(spark, sets, jaccard.Rule(85, 100), lambda wanted: sets.where("false").select("node", "bits"), [])
    assert jaccard.connect(c, sets.selectExpr("1L as entry", "node", "n")) is None
    assert opened.count("cell") <= 4


def test_words_that_a_task_remembers_take_little_memory():
    """300,000 different words (before: all of them were kept)."""
    import tracemalloc

    shingles = jaccard.Shingles(4)
    tracemalloc.start()
    try:
        for i in range(300):
            shingles.tokens([b"word%d" % k for k in range(1000 * i, 1000 * i + 1000)])
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()


def test_pairs_of_earlier_rounds_are_left_out_by_one_join(spark, monkeypatch):
    """Three rounds' pairs and three batches of whole sets (before: a join for each, all of them in one task)."""
    sets = spark.createDataFrame([(i, np.arange(40 + i % 3, dtype=np.uint64).tobytes()) for i in range(8)], "node long, tokens binary")
    plans, real = {}, jaccard.materialize

    def seen(s, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(s, df, name)

    monkeypatch.setattr(jaccard, "materialize", seen)
    c = jaccard._Connecting(spark, sets, jaccard.Rule(85, 100), lambda wanted: sets.join(wanted, "node", "left_semi"),
                            [real(spark, sets.where(f"node = {i}"), "test-whole") for i in range(3)])
    c.tried = [real(spark, spark.createDataFrame([(0, i)], "a long, b long"), "test-tried") for i in range(1, 4)]
    c.compare(spark.createDataFrame([(0, i) for i in range(1, 6)], "a long, b long"))
    assert {r["b"] for r in c.tried[-1].collect()} == {4, 5}
    assert {r["node"] for r in c.whole[-1].collect()} == {4, 5}
    assert {r["node"] for r in c.roots.collect()} == {0, 4, 5}
    assert plans["jaccard-possible"].count("Join LeftAnti") == 1
    assert plans["jaccard-wanted"].count("Join LeftAnti") <= 2  # one for each end of the pairs


def test_results_are_sent_in_parts():
    """10,000 rows of a batch (before: their token sets were held at once)."""
    import pyarrow as pa

    parts = [len(x) for x in jaccard.slices(iter([pa.array(["a"] * 10_000), pa.array([], pa.string()), pa.array(["b"])]))]
    assert sum(parts) == 10_001 and max(parts) <= 1024
