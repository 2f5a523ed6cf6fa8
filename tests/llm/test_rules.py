import random
import re
from collections import Counter

from odd_inputs import no_docs, odd_docs, odd_rows  # noqa: F401

from tessera.llm import rules as R
from tessera.llm.common import load

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {j for i in range(len(ws) - 2) if windows[tuple(ws[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_figures_against_brute_force(spark, odd_docs, odd_rows):
    more = [(300, "a b c a b c a b"), (301, "x y\nx y\n\n \nx y"), (302, "# * | <b>"), (303, "A a A a A a"), (304, "\u00a0 nbsp\u2003wide")]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = Counter((r[0], *r[1:6], r.base_failed) for r in R.score(spark, docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for d, t in odd_rows + more:
        b = brute(t)
        want[(d, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert got == want


def test_kept_needs_base_and_posterior(spark, odd_docs):
    for r in R.score(spark, odd_docs).collect():
        assert 0 <= r.quality <= 1 and r.kept == (not r.base_failed and r.quality >= 0.5)


def test_fit_recovers_rule_accuracies():
    random.seed(4)
    rates = [(0.02, 0.7), (0.05, 0.6), (0.01, 0.8), (0.1, 0.5)]  # bad votes on good and on bad texts
    votes = Counter()
    for _ in range(40_000):
        good = random.random() < 0.8
        votes[tuple(2 if random.random() < rate[not good] else 1 for rate in rates)] += 1
    model = R.fit(sorted(votes.items()))
    assert abs(model.prior - 0.8) < 0.03
    for j, (on_good, on_bad) in enumerate(rates):
        assert abs(model.good[j][2] - on_good) < 0.03 and abs(model.bad[j][2] - on_bad) < 0.08


def test_labelled_junk_goes_and_clean_texts_stay(spark):
    sf = "/root/testdata/sf0.01"
    rows = R.score(spark, load(spark, sf, "documents")).drop("quality").join(load(spark, sf, "labels", "doc_id", "quality"), "doc_id").collect()
    assert not any(r.kept for r in rows if r.quality == 0)
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)




def test_no_python_in_the_plan(spark, odd_docs):
    plan = R.measure(spark.sql("select 1L as doc_id, 'a b c' as text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark, no_docs):
    assert R.score(spark, no_docs).count() == 0
