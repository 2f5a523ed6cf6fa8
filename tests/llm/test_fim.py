import random
import re
from collections import Counter
from hashlib import sha256

import pytest

from odd_inputs import no_docs, odd_docs, odd_rows  # noqa: F401
from tessera.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    t = text or ""
    u = UNIT.findall(t)
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, t
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 20:
        return len(u), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return len(u), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_unit_ends_and_code_points_against_a_pattern():
    random.seed(1)
    for _ in range(2000):
        t = "".join(random.choice("abZ@[`{zA é漢😀\n\x00\x7f<P>M1") for _ in range(random.randint(0, 40)))
        u, units = fim.Units(t.encode()), UNIT.findall(t)
        assert u.n == len(units)
        for k in range(u.n + 1):
            before = "".join(units[:k])
            assert u.end(k) == len(before.encode()) and u.chars(u.end(k)) == len(before)


def test_odd_documents_against_brute_force(spark, odd_docs, odd_rows):
    rows = odd_rows + [(5000 + k, t) for k, t in enumerate(["<P>", "a<M> b", "a<S", "P>b <", "<<P><<S><<M>", "x" * 200_000 + "é"])] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as fim", "'r' as restored", "0 as n")
    out = fim.with_restored(fim.transform(docs.repartition(3)))
    got = Counter((r.doc_id, *r.fim, r.restored_) for r in out.collect())
    assert got == Counter((d, *brute(d, t), t or "") for d, t in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}


def test_parts_that_end_in_pieces_of_a_mark():
    for t in ["<", "<<S", "S>", "a<P", "><M", "<S<P<M"]:
        for k in range(60):
            out = fim.transform_text(t, f"1:{k}")
            assert fim.restore_text(out["output"], out["form"]) == t


def test_marks_that_overlap_are_refused(odd_docs):
    for marks in [("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aba", "y", "z")]:
        with pytest.raises(ValueError):
            fim.transform(odd_docs, marks=marks)


def test_empty_table(no_docs):
    assert fim.with_restored(fim.transform(no_docs)).count() == 0
