import hashlib
import random
from collections import Counter

import pytest

from odd_inputs import no_docs, odd_docs, odd_rows  # noqa: F401
from tessera.llm import suffix as S


def brute(texts, length):
    """Per text: flags of the bytes to remove."""
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append(bytes(gone))
    return out


def test_deep_shallow_order_and_common_prefixes():
    random.seed(1)
    for _ in range(500):
        prefix = bytes(random.choice(b"ab") for _ in range(random.choice([0, 3, 70, 200])))
        strings = [prefix[:random.choice([len(prefix), random.randint(0, len(prefix))])] + bytes(random.choice(b"ab") for _ in range(random.randint(0, 20)))
                   for _ in range(random.randint(2, 14))]
        order, lcp = S.deep_shallow(strings)
        assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)
        for k in range(1, len(order)):
            a, b = strings[order[k - 1]], strings[order[k]]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == n


def test_every_window_has_one_anchor(monkeypatch):
    random.seed(3)
    for step in (50, 1 << 21):
        monkeypatch.setattr(S, "STEP_BYTES", step)
        texts = [bytes(random.choice(b"abc ") for _ in range(random.randint(0, 300))) for _ in range(20)]
        for t, rows in zip(texts, S._runs(texts, 40)):
            starts = [s for _, first, last, _ in rows.tolist() for s in range(first, last + 1)]
            assert starts == list(range(len(t) - 39))


def test_anchors_do_not_depend_on_the_texts_hashed_together(spark, tmp_path):
    random.seed(0)
    prose = lambda n: "".join(random.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    # the passage's two smallest 16-grams: their hashes agree in the upper 42 bits, the right one's is smaller
    passage = prose(100) + "vpobfzjagdtggswl" + prose(130) + "wcagxjqaqpggwgfo" + prose(170)
    beside = prose(S.STEP_BYTES - 52)
    alone, among = S._runs([passage.encode()], 400)[0], S._runs([passage.encode(), beside.encode()], 400)[0]
    assert alone.tolist() == among.tolist()
    for k, rows in enumerate([[(1, passage)], [(2, passage), (3, beside)]]):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/{k}")
    docs = spark.read.parquet(f"{tmp_path}/0").unionAll(spark.read.parquet(f"{tmp_path}/1"))
    assert {r.doc_id: r.n_removed for r in S.repeated_bytes(spark, docs).collect()} == {1: 432, 2: 432, 3: 0}


@pytest.mark.parametrize("group", [20_000, 1])
def test_repeated_bytes_against_brute_force(spark, odd_docs, odd_rows, group, monkeypatch):
    monkeypatch.setattr(S, "GROUP_CONTEXTS", group)  # the small bound counts windows instead of sorting
    texts = [(t or "").encode() for _, t in odd_rows]
    want = Counter()
    for (d, _), t, gone in zip(odd_rows, texts, brute(texts, 400)):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[(d, len(t), sum(gone), len([x for x in gone.split(b"\0") if x]), hashlib.sha256(kept).hexdigest())] += 1
    got = Counter(map(tuple, S.repeated_bytes(spark, odd_docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == want


def test_short_windows_in_spark(spark, monkeypatch):
    random.seed(9)
    parts = [bytes(random.choice(b"abcdefgh ") for _ in range(150)).decode() for _ in range(5)]
    rows = []
    for k in range(40):
        t = ""
        for _ in range(random.randint(0, 4)):
            p = random.choice(parts)
            i = random.randint(0, 150)
            t += p[i:random.randint(i, 150)] + random.choice(["", "x" * 50])
        rows.append((k, t))
    gone = brute([t.encode() for _, t in rows], 40)
    got = {r.doc_id: r.n_removed for r in S.repeated_bytes(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), length=40).collect()}
    assert got == {d: sum(g) for (d, _), g in zip(rows, gone)}


def test_remove_repeats(spark, odd_docs, odd_rows):
    out = S.remove_repeats(spark, odd_docs)
    assert out.columns == odd_docs.columns
    texts = [(t or "").encode() for _, t in odd_rows]
    want = Counter()
    for (d, t), x, gone in zip(odd_rows, texts, brute(texts, 400)):
        want[(d, t if not any(gone) else bytes(b for b, g in zip(x, gone) if not g).decode("utf-8", "ignore"))] += 1
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want


def test_empty_table(spark, no_docs):
    assert S.repeated_bytes(spark, no_docs).count() == 0
    assert S.remove_repeats(spark, no_docs).count() == 0


def test_window_must_hold_two_grams(spark, odd_docs):
    with pytest.raises(ValueError):
        S.repeated_bytes(spark, odd_docs, length=10)
