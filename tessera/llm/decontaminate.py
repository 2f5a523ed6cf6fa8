"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton holds the word sequences of all items. Document words stream through it and the
longest matching length is tracked; wherever it reaches a window's length the window occurs in an
item. Runs of words whose neighbouring pairs occur in no item cannot hold a window and are skipped
beforehand with a sorted array of the items' word pairs; the automaton alone decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialize, row_udf

#: Everything but digits, letters and bytes from 0x80 becomes a space; A-Z are lowered.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of items that one automaton holds (it is broadcast: about 1 kB a word at most); a larger
#: benchmark is searched in several passes, each with the next part of the items.
WORDS_PER_AUTOMATON = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


class Automaton:
    """Generalised suffix automaton over word ids with the windows' items at its states."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.id: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        rows = [(k, [self.id.setdefault(w, len(self.id)) for w in ws]) for k, ws in items if ws]
        for _, seq in rows:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: state of a window's words -> its items; state -> short items that end there
        self.full: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        pairs = set()
        for k, seq in rows:
            pairs.update(a * len(self.id) + b for a, b in zip(seq, seq[1:]))
            s = 0
            for i, c in enumerate(seq):
                s = self.next[s][c]
                if i + 1 >= window:
                    s = self._at(s, window)
                    self.full.setdefault(s, set()).add(k)
            if len(seq) < window:
                self.short.setdefault(s, []).append((len(seq), k))
        self.pairs = np.array(sorted(pairs), np.int64)
        self.least = min((min(len(seq), window) for _, seq in rows), default=0)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur = self._new({}, self.len[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def _new(self, edges: dict[int, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(-1)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(dict(self.next[q]), self.len[p] + 1)
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _at(self, s: int, length: int) -> int:
        """The state of the last ``length`` words of a match that stands in ``s``."""
        while self.len[self.link[s]] >= length:
            s = self.link[s]
        return s

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges whose neighbouring pairs all occur in items, at least as long as a window."""
        if self.least <= 1:
            return [(0, len(ids))]
        if len(ids) < self.least:
            return []
        key = ids[:-1] * len(self.id) + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        ok = (ids[:-1] >= 0) & (ids[1:] >= 0) & (self.pairs[at] == key)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        long = end - begin + 1 >= self.least
        return list(zip(begin[long].tolist(), (end[long] + 1).tolist()))

    def search(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word ranges covered by windows, and the items of these windows."""
        if not self.least or not ws:
            return [], set()
        ids = np.fromiter(map(self._get, ws), np.int64, len(ws))
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        for begin, end in self._runs(ids):
            s = length = 0
            for i, c in enumerate(ids[begin:end].tolist(), begin + 1):
                while s and c not in self.next[s]:
                    s = self.link[s]
                    length = self.len[s]
                if c not in self.next[s]:
                    continue
                s = self.next[s][c]
                length += 1
                if length >= self.window:
                    items |= self.full[self._at(s, self.window)]
                    found.append((i - self.window, i))
                if self.short:
                    t = s
                    while t > 0:
                        for size, item in self.short.get(t, ()):
                            if size <= length:
                                items.add(item)
                                found.append((i - size, i))
                        t = self.link[t]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items

    def _get(self, w: bytes) -> int:
        return self.id.get(w, -1)


def _automata(spark: SparkSession, items: DataFrame, item_id: str, text: str, window: int) -> list:
    """Broadcast automata of the items, ``WORDS_PER_AUTOMATON`` words each. The benchmark is the one
    table that passes through the driver, item by item, and no automaton outgrows its bound (an item
    longer than the bound has one for itself)."""
    out, part, size = [], [], 0
    rows = items.select(F.col(item_id).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null").orderBy("k", "t")
    for r in rows.toLocalIterator():
        ws = words(r["t"])
        if part and size + len(ws) > WORDS_PER_AUTOMATON:
            out.append(spark.sparkContext.broadcast(Automaton(part, window)))
            part, size = [], 0
        part.append((r["k"], ws))
        size += len(ws)
    out.append(spark.sparkContext.broadcast(Automaton(part, window)))
    return out


_FOUND = "struct<n_words:bigint,spans:array<struct<begin:bigint,end:bigint>>,items:array<bigint>>"


def find(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Per row of ``docs``: ``(doc_id, n_words, spans, items)``. ``spans`` are the maximal word ranges
    covered by windows of ``window`` item words (an item of fewer words is one window); ``items`` the
    sorted ids of items whose windows occur.

    Null and empty texts have no words; items without words or id have no windows; repeated rows are
    judged one by one; extra columns of either table are not read.
    """
    out = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    automata = _automata(spark, items, item_id, item_text, window)
    for n, automaton in enumerate(automata):

        def start(automaton=automaton) -> Callable[[str | None], dict]:
            a = automaton.value

            def one(t: str | None) -> dict:
                ws = words(t)
                spans, found = a.search(ws)
                return {"n_words": len(ws), "spans": [{"begin": x, "end": y} for x, y in spans], "items": sorted(found)}

            return one

        out = out.withColumn(f"f{n}", row_udf(_FOUND, start)(F.col("t")))
        if n < len(automata) - 1:  # one automaton at a time in a task's memory
            out = materialize(spark, out, "decontaminate")
    parts = [f"f{n}" for n in range(len(automata))]
    if len(parts) == 1:
        return out.select(F.col("d").alias(doc_id), "f0.*")
    spans = F.aggregate(F.array_sort(F.concat(*[F.col(f"{p}.spans") for p in parts])), F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)"), _merge_span)
    items_found = F.array_sort(F.array_distinct(F.concat(*[F.col(f"{p}.items") for p in parts])))
    return out.select(F.col("d").alias(doc_id), F.col("f0.n_words"), spans.alias("spans"), items_found.alias("items"))


def _merge_span(acc, s):
    """Sorted spans, one after the other: a span that meets the last one extends it."""
    last = F.element_at(acc, -1)
    longer = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))
    return F.when((F.size(acc) > 0) & (s["begin"] <= F.try_element_at(acc, F.lit(-1))["end"]),
                  F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(s)))


def remove(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
           item_text: str = "text", window: int = 10, max_coverage: float = 0.8) -> DataFrame:
    """``docs`` without contamination: words inside windows are cut from the text (with what stands
    between them), a line break takes their place, and a text of which windows cover ``max_coverage``
    or more is dropped. Cutting can bring words together that form a window again; the text is
    searched until none is left. Other columns and rows pass through; null texts stay."""
    cut = fresh(docs, "__cut")
    automata = _automata(spark, items, item_id, item_text, window)
    if len(automata) > 1:
        return _remove_by_parts(spark, docs, automata, text, max_coverage, cut)

    def start(automaton=automata[0]) -> Callable[[str | None], dict]:
        a = automaton.value
        step = _cutter(max_coverage)

        def one(t: str | None) -> dict:
            state = {"drop": False, "cut": True, "first": 0, "gone": 0, "text": t}
            while state["cut"]:
                t = state["text"]
                ws = words(t)
                state = step(t, len(ws), a.search(ws)[0], state["first"], state["gone"])
            return state

        return one

    out = docs.withColumn(cut, row_udf(_CUT, start)(F.col(text))).where(~F.col(f"{cut}.drop"))
    return out.select(*[F.col(f"{cut}.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


_SPANS = "array<struct<begin:bigint,end:bigint>>"
_CUT = "struct<drop:boolean,cut:boolean,first:bigint,gone:bigint,text:string>"


def _cutter(max_coverage: float) -> Callable[..., dict]:
    """A round of cutting: the text without its spans, its first number of words, the words gone so far."""
    word = re.compile(WORD)

    def step(t: str | None, n_words: int, spans: list[tuple[int, int]], first: int, gone: int) -> dict:
        if not spans:
            return {"drop": False, "cut": False, "first": first, "gone": gone, "text": t}
        first = first or n_words
        gone += sum(y - x for x, y in spans)
        if gone >= max_coverage * first:
            return {"drop": True, "cut": False, "first": first, "gone": gone, "text": None}
        at = [m.span() for m in word.finditer(t.translate(_ASCII_LOWER))]
        for x, y in reversed(spans):
            t = t[:at[x][0]] + "\n" + t[at[y - 1][1]:]
        return {"drop": False, "cut": True, "first": first, "gone": gone, "text": t}

    return step


def _remove_by_parts(spark: SparkSession, docs: DataFrame, automata: list, text: str, max_coverage: float, cut: str) -> DataFrame:
    """``remove`` with a benchmark of several automata, with the rows of a single one: in each round all
    parts search the same text, then their spans together are cut; texts that were cut are searched
    again, with the words of the first text and those gone carried along."""
    cols = docs.columns

    def search(automaton) -> Callable[[], Callable]:
        def start() -> Callable[[str | None], list]:
            a = automaton.value
            return lambda t: [{"begin": x, "end": y} for x, y in a.search(words(t))[0]]

        return start

    def cutting() -> Callable[[dict], dict]:
        step = _cutter(max_coverage)

        def one(row: dict) -> dict:
            spans: list[tuple[int, int]] = []
            for a, b in sorted((s["begin"], s["end"]) for s in row["spans"]):
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
            return step(row["text"], len(words(row["text"])) if spans else 0, spans, row["first"], row["gone"])

        return one

    none = F.expr(f"cast(array() as {_SPANS})")
    zero = F.lit(0).cast("long")
    todo = docs.withColumn(cut, F.struct(zero.alias("first"), zero.alias("gone"), none.alias("spans")))
    settled = None
    while True:
        for automaton in automata:  # one automaton at a time in a task's memory
            spans = F.concat(F.col(f"{cut}.spans"), row_udf(_SPANS, search(automaton))(F.col(text)))
            todo = todo.withColumn(cut, F.struct(F.col(f"{cut}.first").alias("first"), F.col(f"{cut}.gone").alias("gone"), spans.alias("spans")))
            todo = materialize(spark, todo, "decontaminate")
        state = F.struct(F.col(text).alias("text"), *[F.col(f"{cut}.{c}").alias(c) for c in ("first", "gone", "spans")])
        done = materialize(spark, todo.withColumn(cut, row_udf(_CUT, cutting)(state)), "decontaminate")
        done = done.where(~F.col(f"{cut}.drop"))
        rest = done.where(~F.col(f"{cut}.cut")).select(*[F.col(f"`{c}`") for c in cols])
        settled = rest if settled is None else settled.unionByName(rest)
        todo = done.where(F.col(f"{cut}.cut"))
        if todo.isEmpty():
            return settled
        todo = todo.select(*[F.col(f"{cut}.text").alias(c) if c == text else F.col(f"`{c}`") for c in cols],
                           F.struct(F.col(f"{cut}.first").alias("first"), F.col(f"{cut}.gone").alias("gone"), none.alias("spans")).alias(cut))
