"""Quality rules under weak supervision.

Each rule looks at one figure of a text and votes good or bad, or abstains. No rule is trusted as it
is: expectation-maximisation over the counts of vote patterns (3 to the number of rules at most, the
only thing that leaves the executors) estimates how often each rule casts each vote on good and on
bad texts, and the posterior probability of a good text replaces "all rules must pass". All figures
and votes are DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize

SPACE = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Base: fewer words than this fail, and so do texts with more than this percentage of repeated words.
LEAST_WORDS, MOST_REPEATED = 50, 50


@dataclass(frozen=True)
class Vote:
    """Bad where ``value`` lies beyond ``bad``, good on the other side of ``good``, else abstains.
    ``low`` tells that low values are the bad ones."""

    name: str
    value: Column
    good: float
    bad: float
    low: bool = False

    def column(self) -> Column:
        v = self.value
        bad, good = (v < self.bad, v >= self.good) if self.low else (v > self.bad, v <= self.good)
        return F.when(bad, 2).when(good, 1).otherwise(0)


def votes() -> list[Vote]:
    """The rules over the figures of ``measure``; a null value (no words) abstains."""
    words = F.col("n_words")
    return [
        Vote("length", words, good=100, bad=10, low=True),
        Vote("short words", F.try_divide("word_chars", words), good=3, bad=2, low=True),
        Vote("long words", F.try_divide("word_chars", words), good=12, bad=20),
        Vote("symbols in words", F.try_divide("n_symbols", words), good=0.02, bad=0.1),
        Vote("symbols in characters", F.try_divide("n_symbols", "word_chars"), good=0.005, bad=0.03),
        Vote("runs of symbols", F.try_divide("n_symbol_runs", words), good=0.02, bad=0.1),
        Vote("repeated words", F.try_divide("n_repeat_words", words), good=0.1, bad=0.3),
        Vote("repeated lines", F.try_divide("n_dup_lines", "n_lines"), good=0.1, bad=0.4),
        Vote("few different words", F.try_divide("n_distinct_words", words), good=0.25, bad=0.12, low=True),
    ]


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_distinct_words, n_symbol_runs)`` per row; null and empty texts have zeros, extra columns are not read.

    Three-word windows are compared by 64-bit hashes within one text. Texts without a repeated
    window, nearly all of them, stop at a hash set; the others sort their windows.
    """
    t = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    trimmed = F.btrim("t", F.lit(SPACE))
    t = t.select("doc_id", "t", F.when(F.length(trimmed) > 0, F.split(trimmed, SPLIT)).otherwise(F.array().cast("array<string>")).alias("w"))
    count = F.size("w")
    at = F.when(count >= 3, F.sequence(F.lit(1), count - 2)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(at, lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)

    def without(chars: str) -> Column:
        return F.length(F.translate("t", chars, ""))

    t = t.select("doc_id", count.cast("long").alias("n_words"), without(SPACE).cast("long").alias("word_chars"),
                 (F.length("t") - without(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"), windows.alias("h"),
                 F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
                 F.regexp_count("t", F.lit(f"[{SYMBOLS}]+")).cast("long").alias("n_symbol_runs"))
    ordered = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    t = t.select("*", F.when(F.size(F.array_distinct("h")) < F.size("h"), ordered).alias("o"))
    again = F.filter("o", lambda x, i: (x["h"] == F.get("o", i - 1)["h"]) | (x["h"] == F.get("o", i + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return t.select("doc_id", "n_words", "word_chars", "n_symbols",
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                    F.coalesce(F.when(F.col("o").isNotNull(), F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
                    F.size("lines").cast("long").alias("n_lines"), "n_distinct_words", "n_symbol_runs")


@dataclass(frozen=True)
class VoteModel:
    prior: float  # share of good texts
    good: list[list[float]]  # per rule: probabilities of abstaining, voting good, voting bad on a good text
    bad: list[list[float]]

    def posterior(self, columns: list[Column]) -> Column:
        odds = F.lit(math.log(self.prior) - math.log(1 - self.prior))
        for c, g, b in zip(columns, self.good, self.bad):
            odds = odds + F.when(c == 0, math.log(g[0] / b[0])).when(c == 1, math.log(g[1] / b[1])).otherwise(math.log(g[2] / b[2]))
        return 1 / (1 + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> VoteModel:
    """Expectation-maximisation over counted vote patterns. It starts from "any bad vote is bad";
    add-one smoothing keeps every probability above zero, and an empty table gives the even model."""
    n_rules = len(patterns[0][0]) if patterns else 0
    share = [0.05 if 2 in p else 0.95 for p, _ in patterns]
    for _ in range(rounds):
        total = [1.0, 1.0]  # bad, good
        table = [[[1.0] * 3 for _ in range(n_rules)] for _ in range(2)]
        for (p, n), s in zip(patterns, share):
            for y, w in ((0, (1 - s) * n), (1, s * n)):
                total[y] += w
                for j, v in enumerate(p):
                    table[y][j][v] += w
        prior = total[1] / sum(total)
        bad, good = [[[c / sum(row) for c in row] for row in side] for side in table]
        model = VoteModel(prior, good, bad)
        share = []
        for p, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(good[j][v] / bad[j][v]) for j, v in enumerate(p))
            share.append(1 / (1 + math.exp(-odds)) if odds > -700 else 0.0)
    return model if patterns else VoteModel(0.5, [], [])


def score(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The figures of ``measure`` with ``base_failed``, ``quality`` (posterior probability of a good
    text) and ``kept`` (not base_failed and quality at ``threshold`` or more), one row per row."""
    rules = votes()
    names = [f"vote_{j}" for j in range(len(rules))]
    rows = measure(docs, doc_id, text)
    rows = materialize(spark, rows.select("*", *[r.column().alias(n) for r, n in zip(rules, names)]), "quality-votes")
    counted = sorted((tuple(r[:-1]), r[-1]) for r in rows.groupBy(*names).count().toLocalIterator())
    model = fit(counted)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    quality = model.posterior([F.col(n) for n in names])
    return rows.select("*", failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= threshold)).alias("kept"))
