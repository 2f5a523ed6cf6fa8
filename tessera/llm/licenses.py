"""Licence scan by conditional compression.

Words that licence notices use point at candidate blocks, which are taken in stretches of bounded
length. A stretch is compressed by zstandard with each template as a raw dictionary, and with a text
that is no licence; the templates are ranked by the bytes that they save over that text, and the first
in rank whose exact wording differences (words that are missing, added or changed) are few has a place.
The words of that place, and a few around it, are compressed and ranked again, which tells versions
apart that differ in a word; the winner there is the notice (of equal savings, the one with fewer
differences). Its words are taken out and what is left on either side is compressed and ranked anew,
until the last template is refused.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, row_udf

#: Notices by licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("All rights reserved", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Licences named by identifier lines.
IDENTIFIERS = ["Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
               "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
               "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
               "CC-BY-NC-4.0", "Unlicense"]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS]
#: Lower-case strings one of which every notice holds; none spans words, as notices are
#: often wrapped or written into comments.
CUES = [b"licens", b"copyright", b"commons", b"redistribut", b"reserved", b"granted", b"warranty", b"unencumbered"]
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A template counts only if at most this share of its words differs.
MOST_DIFFERENT = 0.15
#: A stretch is so many times as long as the longest notice.
STRETCH = 4
CONTROL = b"the quick brown fox jumps over the lazy dog"


def differences(template: list[bytes], words: list[bytes]) -> tuple[int, int, list[str]]:
    """The stretch of ``words`` nearest to ``template`` by word edits: begin, end and the edits, as
    ``-word`` (missing), ``+word`` (added) and ``word>word`` (changed). Ties: the earliest end, and
    changes before gaps."""
    m, n = len(template), len(words)
    number = {w: k for k, w in enumerate(dict.fromkeys(template))}
    ids = np.array([number.get(w, -1) for w in words], np.int64)
    steps = np.arange(n + 1)
    rows = np.zeros((m + 1, n + 1), np.int64)
    for i, t in enumerate(template, 1):
        rows[i, 0] = i
        rows[i, 1:] = np.minimum(rows[i - 1, :-1] + (ids != number[t]), rows[i - 1, 1:] + 1)
        rows[i] = np.minimum.accumulate(rows[i] - steps) + steps  # added words
    j = end = int(rows[m].argmin())
    i, edits = m, []
    while i:
        if j and rows[i][j] == rows[i - 1][j - 1] + (template[i - 1] != words[j - 1]):
            i, j = i - 1, j - 1
            if template[i] != words[j]:
                edits.append(f"{template[i].decode('utf-8', 'replace')}>{words[j].decode('utf-8', 'replace')}")
        elif rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
            edits.append("-" + template[i].decode("utf-8", "replace"))
        else:
            j -= 1
            edits.append("+" + words[j].decode("utf-8", "replace"))
    return j, end, edits[::-1]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], cues: list[bytes]):
        import zstandard

        self.cues = re.compile(b"|".join(map(re.escape, sorted(cues))))
        self.templates = [(name, WORD.findall(text.encode().translate(LOWER))) for name, text in templates]
        self.reach = max((len(t) for _, t in self.templates), default=0)
        self.counts = [Counter(t) for _, t in self.templates]
        #: Words of the longest notice that may be confirmed: all its differences are added words.
        self.longest = max(1, self.reach + int(MOST_DIFFERENT * self.reach))

        def given(content: bytes) -> zstandard.ZstdCompressor:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=19, dict_data=data)

        self.control = given(CONTROL)
        self.given = [given(b" ".join(ws)) for _, ws in self.templates]

    def blocks(self, low: bytes) -> list[tuple[list[bytes], list[int]]]:
        """Words and their byte places of the text around cues, as far as the longest template reaches
        to either side; blocks that overlap are one."""
        cues = [m.start() for m in self.cues.finditer(low)]
        if not cues:
            return []
        found = [m.span() for m in WORD.finditer(low)]
        starts = [a for a, _ in found]
        ranges: list[list[int]] = []
        k = 0
        for c in cues:
            while k + 1 < len(starts) and starts[k + 1] <= c:
                k += 1
            a, b = max(0, k - self.reach), min(len(found), k + self.reach + 1)
            if ranges and a <= ranges[-1][1]:
                ranges[-1][1] = b
            else:
                ranges.append([a, b])
        return [([low[x:y] for x, y in found[a:b]], [x for x, _ in found[a:b]] + [found[b - 1][1]]) for a, b in ranges if b > a]

    def possible(self, words: list[bytes]) -> list[int]:
        """The templates of which ``words`` have enough words: a word that is missing or changed is one
        difference, so with fewer of them a template would be refused."""
        there = Counter(words)
        found = []
        for k, wanted in enumerate(self.counts):
            size = len(self.templates[k][1])
            shared = sum(min(n, there[w]) for w, n in wanted.items())
            if shared and size - shared <= MOST_DIFFERENT * size:
                found.append(k)
        return found

    def ranked(self, words: list[bytes]) -> list[tuple[int, int]]:
        """``(saved, k)`` of the possible templates, the one that saves most bytes first; ties in the
        order of the templates."""
        possible = self.possible(words)
        if not possible:
            return []
        content = b" ".join(words)
        size = len(self.control.compress(content))
        return sorted(((size - len(self.given[k].compress(content)), k) for k in possible), key=lambda r: (-r[0], r[1]))

    def first(self, words: list[bytes]) -> tuple[int, int, int, int, list[str]] | None:
        """The first template in rank that is not refused: saved bytes, template, begin, end, differences.
        Of equal savings, the template with the smaller share of differences."""
        best, share = None, 0.0
        for saved, k in self.ranked(words):
            if best and saved < best[0]:
                break
            template = self.templates[k][1]
            a, b, edits = differences(template, words)
            if a < b and len(edits) <= MOST_DIFFERENT * len(template) and (best is None or len(edits) / len(template) < share):
                best, share = (saved, k, a, b, edits), len(edits) / len(template)
        return best

    def notices(self, words: list[bytes]) -> list[tuple[int, int, int, int, list[str]]]:
        """The notices of a stretch, none of which share words: saved bytes, template, begin, end, differences."""
        found = []
        rests = [(0, words)]
        while rests:
            at, rest = rests.pop()
            place = self.first(rest)
            if place is None:
                continue
            # another version of a notice may end in a word that this one's nearest place leaves out
            slack = int(MOST_DIFFERENT * len(self.templates[place[1]][1]))
            begin, end = max(0, place[2] - slack), place[3] + slack
            saved, k, a, b, edits = self.first(rest[begin:end])  # not None: the place's own template is not refused there
            a, b = begin + a, begin + b
            found.append((saved, k, at + a, at + b, edits))
            rests += [(at, rest[:a]), (at + b, rest[b:])]
        return sorted(found, key=lambda n: n[2])

    def __call__(self, text: str | None) -> dict:
        low = text.encode().translate(LOWER) if text else b""
        blocks = self.blocks(low)
        notices = []
        for words, places in blocks:
            at = 0
            while at < len(words):
                # a notice that begins in the last part of a stretch may be cut: the next one reads it
                end = at + (STRETCH - 1) * self.longest if at + STRETCH * self.longest < len(words) else len(words)
                after = end
                for saved, k, a, b, edits in self.notices(words[at:at + STRETCH * self.longest]):
                    if at + a < end:
                        after = max(after, at + b)
                        notices.append({"license": self.templates[k][0], "begin": places[at + a], "saved": saved, "differences": edits})
                at = after
        return {"n_blocks": len(blocks), "notices": sorted(notices, key=lambda x: (x["begin"], x["license"]))}


def scan(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         templates: list[tuple[str, str]] | None = None, cues: list[bytes] | None = None) -> DataFrame:
    """``(doc_id, n_blocks, notices)`` for each row of ``docs``: the candidate blocks of its whole text
    and the confirmed notices with licence, byte place, bytes saved and wording differences.

    Null and empty texts have none; of templates that meet in the same words the one that saves most
    bytes is reported (of equal savings the one with fewer differences); rows that repeat are scanned each, null
    ids too; other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    cues = CUES if cues is None else cues

    def start() -> Callable[[str | None], dict]:
        return Scanner(templates, cues)

    found = row_udf("struct<n_blocks:int,notices:array<struct<license:string,begin:bigint,saved:int,differences:array<string>>>>", start)(F.col(text))
    return docs.select(F.col(doc_id), found.alias("__f")).select(doc_id, "__f.n_blocks", "__f.notices")
