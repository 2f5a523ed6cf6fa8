import random
import re
from collections import Counter

import pytest

from odd_inputs import low, no_docs, odd_docs, odd_rows  # noqa: F401
from tessera.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items, window):
    words = WORD.findall(low(text))
    hit, found = set(), set()
    for k, item in items:
        ws = WORD.findall(low(item))
        size = min(window, len(ws))
        if k is None or not size:
            continue
        windows = {tuple(ws[i:i + size]) for i in range(len(ws) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(k)
    return len(words), hit, found


def test_automaton_against_brute_force():
    random.seed(2)
    for _ in range(300):
        window = random.choice([1, 2, 3, 5])
        items = [(k, " ".join(random.choice("abcd") for _ in range(random.randint(0, 9)))) for k in range(random.randint(1, 5))]
        a = D.Automaton([(k, D.words(t)) for k, t in items], window)
        for _ in range(5):
            text = " ".join(random.choice("abcde") for _ in range(random.randint(0, 40)))
            spans, found = a.search(D.words(text))
            n, hit, want = brute(text, items, window)
            assert found == want and {i for x, y in spans for i in range(x, y)} == hit
            assert all(b[0] > a[1] for a, b in zip(spans, spans[1:]))


@pytest.fixture(scope="module")
def items(odd_rows):
    text = dict((d, t) for d, t in odd_rows if d)
    ws = text[11].split(" ")
    return [(1, " ".join(ws[:25])), (2, " ".join(ws[10:40])), (3, None), (4, ""), (5, "Two words"), (None, text[7]), (6, "never seen here"),
            (7, " ".join(ws[5:14])), (7, " ".join(text[13].split(" ")[100:130]))]


@pytest.mark.parametrize("bound", [10 ** 6, 30])
def test_find_against_brute_force(spark, odd_docs, odd_rows, items, bound, monkeypatch):
    monkeypatch.setattr(D, "WORDS_PER_AUTOMATON", bound)  # the small bound takes several passes
    table = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as spans", "2 as k")
    got = Counter((r.doc_id, r.n_words, frozenset(i for s in r.spans for i in range(s.begin, s.end)), tuple(r["items"]))
                  for r in D.find(spark, odd_docs, table).collect())
    want = Counter()
    for d, t in odd_rows:
        n, hit, found = brute(t, items, 10)
        want[(d, n, frozenset(hit), tuple(sorted(found)))] += 1
    assert got == want


@pytest.mark.parametrize("bound", [10 ** 6, 30])
def test_remove_leaves_no_window(spark, odd_docs, odd_rows, items, bound, monkeypatch):
    monkeypatch.setattr(D, "WORDS_PER_AUTOMATON", bound)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    out = D.remove(spark, odd_docs, table)
    assert out.columns == odd_docs.columns
    rows = out.select("doc_id", "text").collect()
    kept = Counter(r.doc_id for r in rows)
    for d, t in odd_rows:
        n, hit, _ = brute(t, items, 10)
        if not hit:
            assert (d, t) in {tuple(r) for r in rows}
        elif len(hit) >= 0.8 * n and d is not None:
            assert kept[d] == 0
    if bound > 30:
        assert not any(brute(r.text, items, 10)[1] for r in rows)


def test_remove_gives_the_same_rows_for_every_bound(spark, odd_docs, odd_rows, items, monkeypatch):
    a, b, filler = ([f"{x}{k}" for k in range(60)] for x in "pqz")
    items = items + [(20, " ".join(a[:20])), (21, " ".join(b[:20]))]
    rows = [(900, " ".join(a[:20] + filler[:6] + b[:14])),  # half by one item, 35 % by another
            (901, " ".join(filler + a[:5] + b[:12] + a[5:12])),  # a cut joins words of the other item
            (902, " ".join(filler + a[:5] + b[:6] + a[6:18] + b[6:12] + a[5:12]))]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = []
    for bound in (10 ** 6, 60, 30):
        monkeypatch.setattr(D, "WORDS_PER_AUTOMATON", bound)
        got.append(Counter((r.doc_id, r.text) for r in D.remove(spark, docs, table).collect()))
        assert not any(brute(t, items, 10)[1] for _, t in got[-1])
    assert got[0] == got[1] == got[2]
    assert 900 not in {d for d, _ in got[0]}


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.find(spark, no_docs, none).count() == 0
    assert D.find(spark, odd_docs, none).where("size(spans) > 0 or size(items) > 0").count() == 0
    assert D.remove(spark, odd_docs, none).count() == odd_docs.count()
