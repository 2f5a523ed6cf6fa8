"""SimHash near-duplicates linked through vantage-point trees.

Documents with equal fingerprints collapse first. Two 64-bit fingerprints that differ in at most
``distance`` bits have a 32-bit half that differs in at most ``distance // 2`` bits, and on each half
the Hamming distance is a metric of its own. For either half a vantage-point tree, fitted on a
bounded sample, deals the distinct fingerprints into shards: each is indexed in the shard of its
leaf, and also queried in every shard that its ball of ``distance // 2`` overlaps. Within a shard the
same tree goes on (vectorised over all its queries), branches are pruned by the triangle
inequality, and pairs that remain are confirmed on all 64 bits.

A shard returns a spanning star for each of its components rather than all pairs, so that a large
group of near copies yields as many rows as it has fingerprints; the stars are joined by
``common.components``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, fresh, materialize, words_of

SEED = 42
#: Distinct fingerprints that a shard indexes on average.
SHARD_ROWS = 4096
#: The tree of shards is fitted on one of SAMPLE_RATE fingerprints, at most SAMPLE_ROWS.
SAMPLE_RATE, SAMPLE_ROWS = 64, 1 << 20
LEAF_ROWS = 64
#: Pairs compared in one numpy step.
BLOCK_PAIRS = 1 << 20


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """64-bit SimHash of the space-joined word shingles, repeats included, by XXH64 with seed 42."""
    import xxhash

    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size)
        begin = (end - size)[:len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(begin, (end[shingle - 1:] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at:at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``(doc_id, h, fp)``: a hash of the text and the fingerprint, as signed 64-bit integers."""

    @F.pandas_udf("bigint")
    def fp(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(words_of(t), shingle) for t in s], np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), fp(F.col(text)).alias("fp"))


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = fp.view(np.uint64)
    return u & np.uint64(0xFFFFFFFF), u >> np.uint64(32)


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _radius(d: np.ndarray) -> int | None:
    """A radius that splits distances ``d`` into two parts that are not empty: the median if it does."""
    low, high = int(d.min()), int(d.max())
    return None if low == high else min(max(int(np.median(d)), low), high - 1)


def fit_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes ``(vantage point, radius, inner child, outer child)`` of a tree over ``sample`` with about
    ``leaves`` leaves; a child below zero is the leaf ``-1 - child``. Empty: a single leaf 0."""
    nodes: list[tuple[int, int, int, int]] = []
    n_leaves = 0

    def grow(part: np.ndarray, want: int) -> int:
        nonlocal n_leaves
        radius = None
        if want > 1 and len(part) > 1:
            point = part[len(part) // 2]
            d = _distance(part, point)
            radius = _radius(d)
        if radius is None:
            n_leaves += 1
            return -n_leaves
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        inner = grow(part[d <= radius], want // 2)
        outer = grow(part[d > radius], want - want // 2)
        nodes[at] = (int(point), radius, inner, outer)
        return at

    grow(sample, leaves)
    return nodes


def _deal(tree: list, sub: np.ndarray, reach: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Shards of the tree with the rows that meet them: ``(leaf, rows, whether at home there)``."""
    out = []
    stack = [(0 if tree else -1, np.arange(len(sub)), np.ones(len(sub), bool))]
    while stack:
        at, rows, home = stack.pop()
        if not len(rows):
            continue
        if at < 0:
            out.append((-1 - at, rows, home))
            continue
        point, radius, inner, outer = tree[at]
        d = _distance(sub[rows], np.uint64(point))
        a, b = d - reach <= radius, d + reach > radius
        stack += [(inner, rows[a], (home & (d <= radius))[a]), (outer, rows[b], (home & (d > radius))[b])]
    return out


class _Links:
    """Union-find over row numbers, fed with arrays of pairs; a root is its component's least row."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while True:
                over = self.up[self.up]
                if np.array_equal(over, self.up):
                    break
                self.up = over


def _compare(fp: np.ndarray, index: np.ndarray, query: np.ndarray, distance: int, links: _Links) -> None:
    step = max(1, BLOCK_PAIRS // max(1, len(index)))
    for at in range(0, len(query), step):
        q = query[at:at + step]
        i, j = np.nonzero(_distance(fp[q][:, None], fp[index][None, :]) <= distance)
        links.add(q[i], index[j])


def shard_links(fp: np.ndarray, sub: np.ndarray, home: np.ndarray, distance: int) -> np.ndarray:
    """Component root (row number) of each row by the pairs at ``distance`` or less between a home row
    and any row whose ``sub`` halves are ``distance // 2`` apart at most."""
    links = _Links(len(fp))
    stack = [(np.flatnonzero(home), np.arange(len(fp)), sub, distance // 2, 0)]
    while stack:
        index, query, metric, reach, tries = stack.pop()
        if not len(index) or not len(query):
            continue
        if len(index) <= LEAF_ROWS:
            _compare(fp, index, query, distance, links)
            continue
        point = metric[index[(len(index) // 2 + tries * 7919) % len(index)]]
        d = _distance(metric[index], point)
        radius = _radius(d)
        if radius is None:
            if metric is sub:  # one half is equal in all of them: all 64 bits are the metric from here on
                stack.append((index, query, fp, distance, 0))
            else:
                _compare(fp, index, query, distance, links)
            continue
        dq = _distance(metric[query], point)
        for part, meets in ((d <= radius, dq - reach <= radius), (d > radius, dq + reach > radius)):
            if part.sum() * meets.sum() * 100 > len(index) * len(query) * 95 and metric is fp:
                _compare(fp, index[part], query[meets], distance, links)  # the split prunes nothing
            else:
                stack.append((index[part], query[meets], metric, reach, tries + 1))
    return links.up


def link_fingerprints(spark: SparkSession, distinct: DataFrame, distance: int = 3) -> DataFrame:
    """``(node, root)`` of every fingerprint in ``distinct(fp)`` that has a link to another one."""
    n = distinct.count()
    rate = max(SAMPLE_RATE, -(-n // SAMPLE_ROWS))
    sample = distinct.where(F.pmod(F.xxhash64(F.col("fp"), F.lit(SEED)), F.lit(rate)) == 0)
    sample = np.array(sorted(r[0] for r in sample.toLocalIterator()), np.int64)
    leaves = max(1, round(n / SHARD_ROWS))
    trees = [fit_tree(half, leaves) for half in _halves(sample)]
    reach = distance // 2

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for half, (tree, sub) in enumerate(zip(trees, _halves(fp))):
                for leaf, rows, home in _deal(tree, sub, reach):
                    k = np.full(len(rows), 2 * leaf + half, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[rows]), pa.array(home)], names=["shard", "fp", "home"])

    def link(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy()
        order = np.argsort(fp, kind="stable")
        fp, home = fp[order], table["home"].to_numpy()[order]
        half = table["shard"][0].as_py() % 2
        up = shard_links(fp.view(np.uint64), _halves(fp)[half], home, distance)
        linked = np.flatnonzero(up != np.arange(len(up)))
        return pa.table({"a": fp[linked], "b": fp[up[linked]]})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, fp bigint, home boolean")
    return components(spark, dealt.groupBy("shard").applyInArrow(link, "a bigint, b bigint"), "simhash")


def near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = 3, distance: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    Fingerprints that differ in ``distance`` bits or fewer are linked; ``component_id`` is the smallest
    doc_id reachable over links (null where the whole component has null ids). Null, empty and
    wordless texts have fingerprint zero and are linked like any other; repeated rows are kept, each
    with its component; other columns are not read; an empty table gives an empty result.
    """
    found = _labelled(spark, docs, doc_id, text, shingle, distance)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _labelled(spark: SparkSession, docs: DataFrame, doc_id: str, text: str, shingle: int, distance: int) -> DataFrame:
    """``(doc_id, h, fp, root, component_id)`` for each row; ``root`` names the component."""
    prints = materialize(spark, with_fingerprint(docs, doc_id, text, shingle), "simhash-fp")
    distinct = materialize(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = link_fingerprints(spark, distinct, distance)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "root").select("fp", "root", "component_id")
    return prints.join(labels, "fp").select("doc_id", "h", "fp", "root", "component_id")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                         shingle: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id (of different texts under that
    id the one whose fingerprint and hash are smallest); of repeated rows one stays. Texts that share an id but no
    component are documents of their own. Rows without an id cannot be named as representatives and all stay."""
    found = _labelled(spark, docs, doc_id, text, shingle, distance)
    names = [fresh(docs, f"__keep_{c}") for c in ("id", "h")]
    keep = found.where(F.col("doc_id") == F.col("component_id")).groupBy("root").agg(F.min(F.struct("doc_id", "fp", "h")).alias("k"))
    keep = keep.select(F.col("k.doc_id").alias(names[0]), F.col("k.h").alias(names[1])).distinct()
    same = (F.col(f"`{doc_id}`") == F.col(names[0])) & (F.xxhash64(F.col(f"`{text}`")) == F.col(names[1]))
    kept = docs.join(keep, same).dropDuplicates(names).drop(*names)
    return kept.unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
