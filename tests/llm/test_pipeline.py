import hashlib
from collections import Counter

import pytest
import public_tokenizers as P
import numpy as np

import corpus_pipeline as C
from tessera.llm import bpe, common, decontaminate, quality, simhash
from odd_inputs import odd_docs, odd_rows  # noqa: F401
from test_simhash import brute_print, brute_roots
from test_suffix import brute as brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.load(spark, SF, "documents")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(common.materialize(spark, stage(spark, out[-1], SF), "pipeline-test"))
    return out


def test_stage_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "byte-level BPE"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_rejected_documents_go(spark, stages):
    labels = common.load(spark, SF, "labels", "doc_id", "quality").where(~quality.held_out("doc_id", 5, 0))
    model, grams = quality.fit(spark, stages[0], labels), quality.Grams()
    want = {r.doc_id for r in stages[0].collect() if model.score(grams(r.text)) >= 0.3}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_one_of_each_group_stays(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[1].collect())
    roots = brute_roots([brute_print(t) for _, t in rows])
    assert {r.doc_id for r in stages[2].collect()} == {rows[r][0] for r in set(roots)}


def test_repeats_are_cut(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    texts = [(t or "").encode() for _, t in rows]
    want = {d: bytes(b for b, g in zip(x, gone) if not g).decode("utf-8", "ignore") for (d, _), x, gone in zip(rows, texts, brute_repeats(texts, 240))}
    got = stages[3].collect()
    assert {r.doc_id: r.text or "" for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_no_benchmark_window_is_left(spark, stages):
    items = [(r.item_id, decontaminate.words(r.text)) for r in common.load(spark, SF, "benchmark").collect()]
    a = decontaminate.Automaton(items, 10)
    before = {r.doc_id: r.text for r in stages[3].collect()}
    after = {r.doc_id: r.text for r in stages[4].collect()}
    assert not any(a.search(decontaminate.words(t))[0] for t in after.values())
    clean = {d for d, t in before.items() if not a.search(decontaminate.words(t))[0]}
    assert clean <= set(after) and all(after[d] == before[d] for d in clean)


def test_tokens(stages):
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    token = {v: k for k, v in ranks.items()}
    for r in stages[5].collect():
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert r.round_trip and r.n_tokens == len(ids) and b"".join(token[i] for i in ids.tolist()) == (r.text or "").encode()


def test_run_is_the_stages(spark, stages):
    key = lambda df: Counter((r.doc_id, r.n_tokens, hashlib.sha256(bytes(r.ids)).hexdigest()) for r in df.collect())
    assert key(C.run(spark, SF)) == key(stages[5])


def test_stages_on_odd_documents(spark, odd_docs, odd_rows):
    docs = odd_docs.selectExpr("*", "cast(null as string) as lang", "if(doc_id % 2 = 0, 'a', null) as source", "cast(null as bigint) as n_chars")
    columns, rows = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = common.materialize(spark, stage(spark, docs, SF), "pipeline-odd")
        assert docs.columns == columns and docs.count() <= rows
        rows = docs.count()
    out = C.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == rows and all(r.round_trip for r in out)
    assert all(r.n_tokens == 0 for r in out if not r.text)


def test_empty_documents(spark):
    docs = common.load(spark, SF, "documents").where("false")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
