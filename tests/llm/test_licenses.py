import random

from odd_inputs import no_docs, odd_docs, odd_rows  # noqa: F401

from tessera.llm import licenses as L

NOISE = "thonre is was anly hend and oftionnten enti wherer anhe " * 30


def scan(text):
    return L.Scanner(L.TEMPLATES, L.CUES)(text)


def test_each_template_is_found_in_noise():
    for name, template in L.TEMPLATES:
        for text in (template, NOISE + "\n" + template + "\n" + NOISE, NOISE + template.upper().replace(" ", "\n// ") + " " + NOISE):
            found = scan(text)["notices"]
            assert [(n["license"], n["differences"]) for n in found] == [(name, [])], (name, text[:80], found)


def test_differences_are_exact():
    words = b"some words this work is licenced under the gnu public general license version 3 more".split()
    template = L.WORD.findall(b"this work is licensed under the gnu general public license version 3")
    a, b, edits = L.differences(template, words)
    assert edits.count("licensed>licenced") == 1 and len(edits) == 3 and words[a:a + 2] == [b"this", b"work"] and words[b - 1] == b"3"
    assert L.differences(template, template) == (0, len(template), [])


def test_several_notices_and_other_versions():
    text = NOISE + "Licensed under CC BY-NC 4.0. " + NOISE * 3 + "Released under the MIT License. " + NOISE + "Released under the MIT License."
    assert [n["license"] for n in scan(text)["notices"]] == ["CC-BY-NC-4.0", "MIT", "MIT"]
    assert [n["license"] for n in scan("Licensed under CC BY-SA 4.0.")["notices"]] == ["CC-BY-SA-4.0"]


def test_no_notice():
    for text in (None, "", " ", NOISE, "a licensed plumber came", "copyright", "warranty void", "the license"):
        assert scan(text)["notices"] == []


def test_notices_in_long_licence_like_blocks():
    vocabulary = sorted({w.decode() for _, t in L.TEMPLATES for w in L.WORD.findall(t.lower().encode())})
    for seed in range(10):
        draw = random.Random(seed)
        words = [draw.choice(vocabulary) for _ in range(4000)]
        for name, notice in (("All rights reserved", "All rights reserved."), ("MIT", "Released under the MIT License.")):
            at = draw.randrange(len(words))
            before = " ".join(words[:at]) + " x x x. "
            text = before + notice + " x x x " + " ".join(words[at:])
            found = scan(text)
            assert [(n["license"], n["differences"]) for n in found["notices"] if n["begin"] == len(before)] == [(name, [])], (seed, notice)


def test_altered_and_exact_notice_in_either_order():
    exact = "This work is licensed under the GNU General Public License, version 3."
    altered = exact.replace("licensed", "licenced")
    for texts in ((altered, exact), (exact, altered), (altered, exact, altered), (altered, altered, exact)):
        text = "\n".join(texts)
        want = [(text.index(t, sum(len(x) + 1 for x in texts[:i])), ["licensed>licenced"] if t == altered else []) for i, t in enumerate(texts)]
        assert [(n["begin"], n["differences"]) for n in scan(text)["notices"]] == want
        assert {n["license"] for n in scan(text)["notices"]} == {"GPL-3.0"}


def test_very_long_text_and_places():
    text = NOISE * 400 + "All rights reserved." + NOISE * 400
    (n,) = scan(text)["notices"]
    assert text.encode()[n["begin"]:].startswith(b"All rights reserved")


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    out = L.scan(spark, odd_docs)
    assert out.columns == ["doc_id", "n_blocks", "notices"] and out.count() == odd_docs.count()
    assert out.where("size(notices) > 0").count() == 0
    assert L.scan(spark, no_docs).count() == 0


def test_compression_decides():
    class Constant:
        def compress(self, content):
            return b""

    blind = L.Scanner(L.TEMPLATES, L.CUES)
    blind.control, blind.given = Constant(), [Constant() for _ in blind.given]
    # the longer reading explains more of the text, so it saves more, though the short one has no differences
    readings = [("Apache-2.0", 1, "obtain", "get"), ("MIT", 14, "merge", "join"), ("MPL-2.0", 17, "distributed", "given")]
    for name, k, word, other in readings:
        assert L.TEMPLATES[k][0] == name
        text = L.TEMPLATES[k][1].replace(word, other, 1)
        for whole in (text, NOISE + text + " " + NOISE):
            assert [(n["license"], n["differences"]) for n in scan(whole)["notices"]] == [(name, [f"{word}>{other}"])]
            assert [(n["license"], n["differences"]) for n in blind(whole)["notices"]] != [(name, [f"{word}>{other}"])]


def test_versions_that_differ_in_a_word():
    grant = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License"
    for text, name in (("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), (grant.format("Affero "), "AGPL-3.0"), (grant.format(""), "GPL-3.0"),
                       (grant.format("Lesser "), "LGPL-3.0"), ("SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL-3.0-or-later")):
        for whole in (text, NOISE + text + " " + NOISE):
            assert [(n["license"], n["differences"]) for n in scan(whole)["notices"]] == [(name, [])]


def test_versions_side_by_side():
    texts = [t for _, t in L.TEMPLATES]
    names = [n for n, _ in L.TEMPLATES]
    for seed in range(2):
        order = random.Random(seed).sample(range(len(texts)), len(texts))
        found = scan(" xx yy zz. ".join(texts[k] for k in order))["notices"]
        assert [n["license"] for n in found] == [names[k] for k in order]
        assert all(n["differences"] == [] for n in found)


def test_planted_notices_through_spark(spark):
    rows = [(1, NOISE + "Released under the MIT License. " + NOISE), (1, NOISE + "Released under the MIT License. " + NOISE),
            (None, "All rights reserved."), (2, None), (3, ""), (4, "SPDX-License-Identifier: ISC\n" + NOISE * 200)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, notices string").repartition(3)
    found = sorted((str(r["doc_id"]), [(n["license"], n["begin"], n["differences"]) for n in r["notices"]]) for r in L.scan(spark, docs).collect())
    assert found == [("1", [("MIT", len(NOISE), [])])] * 2 + [("2", []), ("3", []), ("4", [("ISC", 0, [])]), ("None", [("All rights reserved", 0, [])])]
