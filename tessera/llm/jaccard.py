"""Set-similarity join of documents on word shingles, by prefixes of token combinations.

Equal sets collapse first. All shingles ("tokens") have one global order: rare ones (in ``FEW`` sets or
fewer, counted over all sets) come before frequent ones; rare ones whose hash lies in a band of a fixed
width come before the others; the hash decides the rest. A set of n tokens whose partner may lack t of
them (all that the threshold leaves) files itself under the tokens of its prefix: every rare token
alone, and frequent tokens in pairs. For pairs, frequent tokens are dealt into classes by a hash; a class with m
tokens of the prefix yields m(m-1)/2 pairs and stands for m-1 tokens, and the prefix is extended until rare
tokens and classes make up t+1. If two linked sets shared neither a rare prefix token nor a pair of any
class, the one whose prefix ends first would lack t+1 tokens of the other, which is too many; so no link
is lost. Entries are split by the size of the set in levels (a partner is at most one level away, hence each
set files under two); the number of classes follows from the level, which keeps the pairs proportional
to the set.

Most sets have t+1 rare tokens inside the band, so only the band's tokens are counted for all sets. Where
they do not suffice, the set is read whole and its other tokens are counted among such sets. Pairs of
frequent tokens are left for sets that consist of frequent tokens almost entirely.

Candidates that share an entry are verified in two steps: a parity sketch of one to two bits a token bounds
the difference of two sets from below, then whole sets are compared. It goes in rounds. First each entry
compares its members with one pivot. Then entries of few members compare the rest with each other, and
larger ones join in cells, all entries of one pivot together, so that members they have in common meet
once; a cell picks pivots anew in each round (8, then 64, then 16 times as many each time, so the
rounds are logarithmic), whose sketches meet those of its members in blocks, and only pairs that may be linked
come back. Members known to be connected are not
compared, pivots leave their cell, and entries and cells whose members are all connected are done. A large
group of near copies is thus settled by about one comparison a member, and no case is left out: rounds go
on until no cell holds two unconnected members that were not compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ROWS_AT_ONCE, components, materialize, words_of

#: Share of all hashes in the band; tokens in more than FEW sets are frequent; tokens of a set to a class; sets up to SHORT are kept whole.
BAND, FEW, PER_CLASS, SHORT = 0.2, 8, 4, 128
#: Tokens that a task sorts at once.
CHUNK = 1 << 18
#: Words whose hash a task remembers, candidate sets that are broadcast to find their texts, pivots of a cell in each round (then 16
#: times as many each time), bytes of sketches that meet as one block.
KNOWN_WORDS, BROADCAST_ROWS, PIVOTS, BLOCK = 1 << 15, 1 << 19, (8, 64), 1 << 16

_END = np.uint64(int(BAND * 2**64))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which all bits of the input matter to all bits of the output."""
    with np.errstate(over="ignore"):
        x = (x + _A)
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


class Shingles:
    """Hashes of word shingles; words that were met before are not hashed again."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def tokens(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles (fewer words than a shingle: of the whole sequence)."""
        import xxhash

        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        size = min(self.size, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = _mix(out ^ h[k:k + len(out)])
        return np.unique(out)


class Rule:
    """Sizes that follow from the link condition ``of * intersection >= at * union``."""

    def __init__(self, at: int, of: int):
        self.at, self.of = at, of
        self.step = math.log(of / at) if at < of else 0.0

    def lacking(self, n: int) -> int:
        """Tokens of a set of ``n`` that a linked set may lack."""
        return n - -(-self.at * n // self.of)

    def may_link(self, n: int) -> bool:
        """Whether a different set can be linked to one of ``n`` tokens (the nearest has one token more)."""
        return n * (self.of - self.at) >= self.at

    def level(self, n: int) -> int:
        return int(math.log(n) / self.step)

    def classes(self, level: int) -> int:
        return max(1, round(math.exp(level * self.step) / PER_CLASS))

    def links(self, n: int, m: int, both: int) -> bool:
        return self.of * both >= self.at * (n + m - both)

    def near(self, n: int, m: int) -> bool:
        """Whether sets of ``n`` and ``m`` tokens can be linked at all."""
        return self.of * np.minimum(n, m) >= self.at * np.maximum(n, m)

    def may_differ(self, n: int, m: int, by: int) -> bool:
        """Whether sets of ``n`` and ``m`` tokens can be linked when at least ``by`` tokens are in one of them only."""
        return (self.of + self.at) * by <= (self.of - self.at) * (n + m)

    def pairs(self, n: int, frequent: np.ndarray) -> np.ndarray:
        """Entries for pairs of ``frequent`` tokens of a set of ``n`` (its other tokens are rare) at both levels."""
        out = []
        missing = self.lacking(n) + 1 - (n - len(frequent))
        frequent = np.sort(frequent)
        for level in (self.level(n), self.level(n) + 1):
            seed = _mix(np.array([level], np.uint64))
            cls = _mix(frequent ^ seed) % np.uint64(self.classes(level))
            order = np.argsort(cls, kind="stable")
            again = np.zeros(len(cls), np.int64)  # whether the token's class has an earlier one
            again[order[1:]] = cls[order[1:]] == cls[order[:-1]]
            end = int(np.searchsorted(np.cumsum(again), missing)) + 1  # of the prefix
            order = order[order < end]
            cls, own = cls[order], frequent[order]
            for k in range(1, len(own)):
                same = cls[k:] == cls[:-k]
                if not same.any():
                    break
                out.append(_mix(_mix(own[:-k][same] ^ seed) ^ own[k:][same]))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Bits (at least as many as tokens, a power of two) that tell whether an odd number of tokens end in that value."""
    size = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def differ_at_least(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound, from their sketches, on the tokens that are in one of two sets only."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _batch(names: str, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names.split())


def slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The batches in parts of some rows, whose results are sent before the next part is read."""
    for batch in batches:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def prints(docs: DataFrame, doc_id: str, text: str, shingle: int, rule: Rule) -> DataFrame:
    """``(doc_id, place, digest, n, inside, base, bits)``: digest of the token set (null if empty), its size, its
    ``inside`` tokens in the band (a short set: and then the others), and its sketch."""

    @F.arrow_udf("struct<digest: binary, n: bigint, inside: int, base: binary, bits: binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingles = Shingles(shingle)
        for batch in slices(batches):
            digest, n, inside, base, bits = [], [], [], [], []
            for t in batch:
                tokens = shingles.tokens(words_of(t.as_py()))
                own = tokens if rule.may_link(len(tokens)) else tokens[:0]
                a = int(np.searchsorted(own, _END))
                digest.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                n.append(len(tokens))
                inside.append(a)
                base.append((own if len(own) <= SHORT else own[:a]).tobytes())
                bits.append(sketch(tokens).tobytes())
            columns = (digest, pa.binary()), (n, pa.int64()), (inside, pa.int32()), (base, pa.binary()), (bits, pa.binary())
            yield pa.StructArray.from_arrays([pa.array(*c) for c in columns], names=["digest", "n", "inside", "base", "bits"])

    c = F.col(f"`{text}`")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(c).alias("place"), run(c).alias("s")).select("doc_id", "place", "s.*")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and lengths of the runs of equal values."""
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return begin, np.diff(np.r_[begin, len(key)])


def dealt_tokens(sets: DataFrame, band: bool) -> DataFrame:
    """``(token, node)`` of the tokens in the band, or of those outside, from ``sets(node, base)``. A token that one task meets in more than FEW sets is known to be
    frequent: its rows carry the node as ``-2 - node`` (they need not meet), and one row with node -1 tells the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            tokens, nodes = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(tokens, kind="stable")
            tokens, nodes = tokens[order], nodes[order]
            begin, length = _runs(tokens)
            often = length > FEW
            nodes = np.where(np.repeat(often, length), -2 - nodes, nodes)
            told = tokens[begin[often]]
            for a in range(0, len(tokens), 1 << 16):
                yield _batch("token node", tokens[a:a + (1 << 16)].view(np.int64), nodes[a:a + (1 << 16)])
            yield _batch("token node", told.view(np.int64), np.full(len(told), -1))

        for b in batches:
            for node, base in zip(b["node"].to_numpy(), b["base"]):
                own = np.frombuffer(base.as_buffer(), np.uint64)
                inside = int(np.searchsorted(own, _END))
                own = own[:inside] if band else own[inside:]
                held.append((own, np.full(len(own), node)))
                size += len(own)
                if size >= CHUNK:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    return sets.select("node", "base").mapInArrow(run, "token bigint, node bigint")


def shared_tokens(dealt: DataFrame) -> DataFrame:
    """``(entry, node, frequent)`` of the tokens that two sets or more have."""
    when = F.when(F.col("node") >= -1, F.col("token")).otherwise(F.col("node"))
    rows = dealt.repartition(when).sortWithinPartitions("token", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(tokens: np.ndarray, nodes: np.ndarray):
            begin, length = _runs(tokens)
            here = np.add.reduceat((nodes >= 0).astype(np.int64), begin)
            often = (here > FEW) | (nodes[begin] < 0)  # nodes below zero come first
            keep = np.repeat(often | (here > 1), length) & (nodes != -1)
            return _batch("entry node frequent", tokens[keep], np.where(nodes < 0, -2 - nodes, nodes)[keep], np.repeat(often, length)[keep])

        left = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in batches:
            tokens, nodes = (np.concatenate([x, b[k].to_numpy()]) for x, k in zip(left, ("token", "node")))
            if len(tokens):
                last = int(np.searchsorted(tokens, tokens[-1]))  # the last token may go on in the next batch
                if last:
                    yield out(tokens[:last], nodes[:last])
                left = tokens[last:], nodes[last:]
        if len(left[0]):
            yield out(*left)

    return rows.mapInArrow(run, "entry bigint, node bigint, frequent boolean")


def short_of_rare(shared: DataFrame, sets: DataFrame, rule: Rule, counted: str) -> DataFrame:
    """``sets(node, n, ...)`` whose rare tokens do not make up the prefix, with their ``frequent`` ones; ``counted`` is the
    number of a set's tokens that were counted."""
    frequent = shared.where("frequent").groupBy("node").agg(F.collect_list("entry").alias("frequent"))
    rare = F.expr(f"{counted} - coalesce(size(frequent), 0)")
    return sets.where(f"n * {rule.of - rule.at} >= {rule.at}").join(frequent, "node", "left").where(rare <= F.expr(f"n - ({rule.at} * n + {rule.of - 1}) div {rule.of}"))


def combined_tokens(rows: DataFrame, rule: Rule) -> DataFrame:
    """``(entry, node, n)`` for pairs of the frequent tokens of ``rows(node, n, frequent)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, n, tokens in zip(*(b[k].to_pylist() for k in ("node", "n", "frequent"))):
                entries = rule.pairs(n, np.array(tokens, np.int64).view(np.uint64))
                yield _batch("entry node n", entries.view(np.int64), np.full(len(entries), node), np.full(len(entries), n))

    return rows.select("node", "n", "frequent").mapInArrow(run, "entry bigint, node bigint, n bigint")


def single_tokens(shared: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """``(entry, node, n)`` for rare tokens, at both levels of a set, so that sets of sizes far apart do not meet."""
    rows = shared.where("not frequent").join(sets.select("node", "n"), "node")
    level = F.floor(F.log("n") / F.lit(rule.step))
    rows = rows.select("entry", "node", "n", F.explode(F.array(level, level + 1)).alias("level"))
    return rows.select(F.xxhash64("entry", "level").alias("entry"), "node", "n")


def whole_sets(spark: SparkSession, docs: DataFrame, doc_id: str, text: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """``(node, tokens)`` of the sets in ``wanted(node, doc_id, place)``, computed again from their texts."""
    n = wanted.count()
    if n <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    w = wanted.toDF("node", "__id", "__place")
    c = F.col(f"`{text}`")
    found = docs.select(F.col(f"`{doc_id}`").alias("id"), c.alias("t"), F.xxhash64(c).alias("place"))
    found = found.join(w, found["place"].eqNullSafe(w["__place"]) & found["id"].eqNullSafe(w["__id"]))

    @F.arrow_udf("binary")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingles = Shingles(shingle)
        for batch in slices(batches):
            yield pa.array([shingles.tokens(words_of(t.as_py())).tobytes() for t in batch], pa.binary())

    sets = materialize(spark, found.select("node", tokens("t").alias("tokens")), "jaccard-sets")
    if sets.count() > n:  # rows that repeat id and text
        sets = materialize(spark, sets.dropDuplicates(["node"]), "jaccard-sets")
    return sets


def possible(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The ``pairs(a, b)`` whose sketches leave a link possible."""

    @F.arrow_udf("boolean")
    def may(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for n, left, m, right in batches:
            rows = zip(n.to_pylist(), left, m.to_pylist(), right)
            yield pa.array([rule.may_differ(i, j, differ_at_least(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)))
                            for i, x, j, y in rows], pa.bool_())

    rows = pairs.join(sets.select("node", "n", "bits").toDF("a", "n", "left"), "a").join(sets.select("node", "n", "bits").toDF("b", "m", "right"), "b")
    return rows.where(may("n", "left", "m", "right")).select("a", "b")


def _by_length(bits: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and sketches, one a row of 64-bit words, of each length of sketch."""
    size = pc.binary_length(bits).to_numpy(zero_copy_only=False)
    at = [np.flatnonzero(size == s) for s in np.unique(size)]
    return [(k, np.frombuffer(b"".join(bits.take(pa.array(k)).to_pylist()), np.uint64).reshape(len(k), -1)) for k in at]


def block_pairs(members: pa.StructArray, pivots: pa.StructArray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the members and pivots (structs of node, n, root, bits) that may be linked and are not connected."""
    (node, n, root), (other, m, its) = ([b.field(k).to_numpy(zero_copy_only=False) for k in ("node", "n", "root")] for b in (members, pivots))
    left, right = [node[:0]], [other[:0]]
    for x, own in _by_length(members.field("bits")):
        for y, pivot in _by_length(pivots.field("bits")):
            width = min(own.shape[1], pivot.shape[1])  # a longer sketch folds to a shorter one
            short = np.bitwise_xor.reduce(own.reshape(len(own), -1, width), axis=1)
            for j, sketch_j in zip(y, np.bitwise_xor.reduce(pivot.reshape(len(pivot), -1, width), axis=1)):
                at = np.flatnonzero((root[x] != its[j]) & rule.near(n[x], m[j]))
                by = np.bitwise_count(short[at] ^ sketch_j).sum(axis=1, dtype=np.int64)
                at = x[at[rule.may_differ(n[x[at]], m[j], by)]]
                left.append(node[at])
                right.append(np.full(len(at), other[j]))
    return np.concatenate(left), np.concatenate(right)


def possible_in_cells(live: DataFrame, chosen: DataFrame, sets: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """``(a, b)`` for members of ``live(cell, node, n, root, k, blocks)`` and unconnected pivots of ``chosen(cell, pivot, with, m, k, blocks)``,
    up to ``parts`` a cell, whose sizes and sketches leave a link possible. Both sides meet in blocks of some ``BLOCK`` bytes."""
    bits = sets.select("node", "bits")
    member_blocks, pivot_blocks = F.ceil("blocks"), F.ceil(F.col("blocks") * F.least(F.lit(1.0), F.lit(float(parts)) / F.col("k")))

    def lists(rows: DataFrame, blocks, name: str, *keep) -> DataFrame:
        part = F.pmod(F.xxhash64(F.col("node"), F.lit(-1)), blocks).alias("part")
        return rows.join(bits, "node").groupBy("cell", part, *keep).agg(F.collect_list(F.struct("node", "n", "root", "bits")).alias(name))

    members = lists(live, member_blocks, "members", pivot_blocks.alias("others")).drop("part")
    members = members.select("cell", "members", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("part"))
    pivots = lists(chosen.toDF("cell", "node", "root", "n", "k", "blocks"), pivot_blocks, "pivots")

    @F.arrow_udf("array<struct<a: bigint, b: bigint>>")
    def may(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            found = [block_pairs(x.values, y.values, rule) for x, y in zip(left, right)]
            cut = np.cumsum([0] + [len(x) for x, _ in found])
            x, y = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            pairs = pa.StructArray.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
            yield pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pairs)

    found = members.join(pivots, ["cell", "part"]).select(F.explode(may("members", "pivots")).alias("p"))
    return found.select("p.a", "p.b").distinct()


def verified(pairs: DataFrame, whole: DataFrame, rule: Rule) -> DataFrame:
    """The ``pairs(a, b)`` that are linked, by their whole sets."""

    @F.arrow_udf("boolean")
    def linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                out.append(rule.links(len(x), len(y), int((y[np.minimum(at, len(y) - 1)] == x).sum())))
            yield pa.array(out, pa.bool_())

    rows = pairs.join(whole.toDF("a", "left"), "a").join(whole.toDF("b", "right"), "b")
    return rows.where(linked("left", "right")).select("a", "b")


class _Connecting:
    """Links and components found so far; whole sets are fetched when a pair first needs them and kept in files."""

    def __init__(self, spark: SparkSession, sets: DataFrame, rule: Rule, fetch: Callable[[DataFrame], DataFrame], whole: list[DataFrame]):
        self.spark, self.sets, self.rule, self.fetch, self.whole = spark, sets, rule, fetch, whole
        self.tried, self.roots = [], None

    def open(self, rows: DataFrame, group: str) -> DataFrame:
        """``rows(group, node, n)`` with their ``root``, without groups whose members are all connected; ``k`` and ``blocks`` are the
        members of the group and the blocks that their sketches fill."""
        root = F.col("node")
        if self.roots is not None:
            rows, root = rows.join(self.roots, "node", "left"), F.coalesce("root", "node")
        rows = rows.select(group, "node", "n", root.alias("root"))
        several = rows.groupBy(group).agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("k"),
                                          (F.sum(F.col("n") / 4 + 40) / BLOCK).alias("blocks")).where("x <> y").drop("x", "y")
        return materialize(self.spark, rows.join(several, group), "jaccard-open")

    def near(self) -> F.Column:
        return F.lit(self.rule.of) * F.least("n", "m") >= F.lit(self.rule.at) * F.greatest("n", "m")

    def compare(self, pairs: DataFrame) -> None:
        """Verify ``pairs(a, b)`` that may be linked and were not compared before, and join the components of the linked ones."""
        if self.tried:  # one join however many rounds there were: each would hold memory of its own in the same task
            pairs = pairs.join(reduce(DataFrame.union, self.tried), ["a", "b"], "left_anti")
        pairs = materialize(self.spark, pairs, "jaccard-possible")
        if pairs.isEmpty():
            return
        self.tried.append(pairs)
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if self.whole:
            wanted = wanted.join(reduce(DataFrame.union, self.whole).select("node"), "node", "left_anti")
        self.whole.append(self.fetch(materialize(self.spark, wanted, "jaccard-wanted")))
        links = verified(pairs, reduce(DataFrame.union, self.whole), self.rule)
        old = self.roots
        if old is not None:
            for c in ("a", "b"):
                links = links.join(old.toDF(c, "r"), c, "left").withColumn(c, F.coalesce("r", c)).drop("r")
        new = components(self.spark, links, "jaccard")
        if old is not None:
            moved = old.join(new.toDF("root", "r"), "root", "left").select("node", F.coalesce("r", "root").alias("root"))
            new = materialize(self.spark, moved.union(new.join(old, "node", "left_anti")), "jaccard-roots")
        self.roots = new


def connect(c: _Connecting, entries: DataFrame) -> DataFrame | None:
    """``(node, root)`` of the sets linked to another one, from ``entries(entry, node, n)``; None if there are none."""

    def pair(x: str, y: str):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    def pivots(live: DataFrame, group: str, parts: int) -> DataFrame:
        order = F.xxhash64(F.col("node"), F.lit(parts))
        part = F.when(F.col("k") <= parts, F.col("node")).otherwise(F.pmod(order, F.lit(parts)))  # all of a group that small
        p = live.groupBy(group, part.alias("part"), "k", "blocks").agg(F.min_by(F.struct("node", "root", "n"), F.struct(order, "node")).alias("p"))
        return materialize(c.spark, p.select(group, F.col("p.node").alias("pivot"), F.col("p.root").alias("with"), F.col("p.n").alias("m"), "k", "blocks"), "jaccard-pivots")

    live = c.open(entries, "entry")
    chosen = pivots(live, "entry", 1)
    pairs = live.join(chosen.drop("k", "blocks"), "entry").where("root <> with").where(c.near()).select(*pair("node", "pivot")).distinct()
    c.compare(possible(pairs, c.sets, c.rule))
    rest = live.join(chosen.select("entry", "pivot"), "entry").where("node <> pivot").select(F.struct("entry", "pivot").alias("entry"), "node", "n")
    live = c.open(rest, "entry")
    small = live.where(F.col("k") < FEW)
    other = small.select("entry", F.col("node").alias("pivot"), F.col("root").alias("with"), F.col("n").alias("m"))
    pairs = small.join(other, "entry").where("node < pivot and root <> with").where(c.near()).select(*pair("node", "pivot")).distinct()
    pairs = possible(pairs, c.sets, c.rule)
    cells = live.where(F.col("k") >= FEW).select(F.col("entry.pivot").alias("cell"), "node", "n").distinct()
    cells = materialize(c.spark, cells, "jaccard-cells")
    turn = 0
    while True:
        live = c.open(cells, "cell")
        if live.isEmpty():
            if not turn:
                c.compare(pairs)
            return c.roots
        parts = PIVOTS[turn] if turn < len(PIVOTS) else PIVOTS[-1] * 16 ** (turn + 1 - len(PIVOTS))
        chosen = pivots(live, "cell", parts)
        more = possible_in_cells(live, chosen, c.sets, c.rule, parts)
        c.compare(more if turn else pairs.union(more).distinct())
        cells = live.join(chosen.select("cell", F.col("pivot").alias("node")), ["cell", "node"], "left_anti").select("cell", "node", "n")
        turn += 1


def similar_documents(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      shingle: int = 4, at: int = 85, of: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``.

    Two documents are linked when ``of * intersection >= at * union`` of their sets of distinct word
    shingles; ``component_id`` is the smallest doc_id reachable over links, itself included (null where the
    component has null ids only). Fewer words than a shingle make a set of the whole sequence; null, empty and
    wordless texts have an empty set and are linked with nothing, not even each other. Repeated rows, and
    different texts under one id, are documents of their own and keep a row each; other columns are not
    read; an empty table gives an empty result. Shingles are compared by 64-bit hashes, equal sets by 128 bits.
    """
    rule = Rule(at, of)
    found = materialize(spark, prints(docs, doc_id, text, shingle, rule), "jaccard-prints")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place")).alias("f")
    same = found.where("n > 0").groupBy("digest").agg(first, F.first("n").alias("n"), F.first("inside").alias("inside"), F.first("base").alias("base"), F.first("bits").alias("bits"))
    sets = materialize(spark, same.select(F.monotonically_increasing_id().alias("node"), "digest", "f.doc_id", "f.place", "n", "inside", "base", "bits"), "jaccard-distinct")

    def fetch(nodes: DataFrame) -> DataFrame:
        return whole_sets(spark, docs, doc_id, text, shingle, sets.join(nodes, "node", "left_semi").select("node", "doc_id", "place"))

    shared = materialize(spark, shared_tokens(dealt_tokens(sets, band=True)), "jaccard-band")
    poor = materialize(spark, short_of_rare(shared, sets.select("node", "n", "inside"), rule, "inside"), "jaccard-poor")
    whole = [sets.where(F.col("n") <= SHORT).select("node", F.col("base").alias("tokens")), fetch(poor.where(F.col("n") > SHORT).select("node"))]
    others = reduce(DataFrame.union, whole).toDF("node", "base").join(poor.select("node"), "node", "left_semi")
    outside = materialize(spark, shared_tokens(dealt_tokens(others, band=False)), "jaccard-outside")
    both = shared.union(outside)
    poorest = short_of_rare(both.join(poor.select("node"), "node", "left_semi"), poor.select("node", "n"), rule, "n")
    entries = single_tokens(both, sets, rule).union(combined_tokens(poorest.where("frequent is not null"), rule))
    entries = materialize(spark, entries, "jaccard-entries")  # read twice
    roots = connect(_Connecting(spark, sets, rule, fetch, whole), entries)
    roots = sets.select("node", F.col("node").alias("root")).limit(0) if roots is None else roots.toDF("node", "root")
    named = sets.join(roots, "node", "left").select("digest", "doc_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = named.join(least, "root").select("digest", "component_id")
    filled = found.where("n > 0").join(labels, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return filled.union(found.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
