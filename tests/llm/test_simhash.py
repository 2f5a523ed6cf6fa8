import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from odd_inputs import low, no_docs, odd_docs, odd_rows  # noqa: F401
from tessera.llm import common, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    ws = WORD.findall(low(text))
    shingles = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints, distance=3):
    up = list(range(len(prints)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints(odd_rows):
    for _, t in odd_rows:
        assert simhash.fingerprint(common.words_of(t)) == brute_print(t)


@pytest.mark.parametrize("spread", [64, 40, 12])
def test_shard_links_against_brute_force(spread, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 4)
    random.seed(spread)
    centres = [random.getrandbits(64) for _ in range(6)]
    prints = sorted({c ^ sum(1 << b for b in random.sample(range(spread), random.randint(0, 5))) for c in centres for _ in range(60)})
    fp = np.array(prints, np.uint64)
    links = simhash._Links(len(fp))
    for sub in simhash._halves(fp.view(np.int64)):
        up = simhash.shard_links(fp, sub, np.ones(len(fp), bool), 3)
        links.add(np.arange(len(fp)), up)
    assert links.up.tolist() == brute_roots(prints)


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_components_against_brute_force(spark, odd_docs, odd_rows, shard_rows, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(simhash, "SAMPLE_RATE", 1)
    got = Counter(map(tuple, simhash.near_duplicates(spark, odd_docs).select("doc_id", "fingerprint", "component_id").collect()))
    prints = [brute_print(t) for _, t in odd_rows]
    roots = brute_roots(prints)
    least = {}
    for (d, _), r in zip(odd_rows, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    assert got == Counter((d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(odd_rows, prints, roots))


def test_drop_keeps_one_of_each_group(spark, odd_docs, odd_rows):
    out = simhash.drop_near_duplicates(spark, odd_docs)
    assert out.columns == odd_docs.columns
    prints = [brute_print(t) for _, t in odd_rows]
    roots = brute_roots(prints)
    least = {}
    for (d, _), r in zip(odd_rows, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = Counter(least.values())
    want[None] = sum(d is None for d, _ in odd_rows)
    assert Counter(r.doc_id for r in out.collect()) == want


def test_texts_under_one_id_are_documents_of_their_own(spark):
    rows = [(1, "one text about ships and the sea"), (1, "quite another text on trees in a wood"), (2, "a third one, of stars"), (2, "a third one, of stars")]
    out = simhash.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, out.collect())) == sorted(set(rows))


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(7, 7)]
    roots = {r.node: r.root for r in common.components(spark, spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert len({roots[k] for k in range(61)}) == 1 and len({roots[1000 + k] for k in range(40)}) == 1 and len(roots) == 101


def test_empty_table(spark, no_docs):
    assert simhash.near_duplicates(spark, no_docs).count() == 0
    assert simhash.drop_near_duplicates(spark, no_docs).count() == 0
