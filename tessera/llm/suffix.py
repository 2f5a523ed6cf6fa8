"""Removal of repeated byte strings by sorting suffixes, deep-shallow style.

Every window of ``LENGTH`` bytes has an anchor: the position in it of its smallest hashed 16-gram
(the leftmost of equal ones). Equal windows have their anchors at equal offsets, so it is enough to
compare what stands around anchors, one position in about 190:

1. Anchors whose neighbourhood of ``LENGTH / 2`` bytes to the right (for windows that reach that far)
   or to the left (for the others) occurs once in the corpus are dropped by a count of hashes.
2. The others bring their context, the bytes of all their windows. Equal contexts collapse with a
   count, so a large group of copies is one row.
3. Within a group of one neighbourhood the contexts' suffixes from the anchor, and their reversed
   prefixes up to it, are sorted: multikey quicksort to a shallow depth, then blind tries for what
   still agrees. The common-prefix lengths of both orders tell for each offset which windows agree.
4. A group of more than ``GROUP_CONTEXTS`` different contexts is not sorted by one task: its windows
   are counted by SHA-256 in a grouped aggregation, which any number of tasks shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialize

GRAM = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed in one numpy step; longer texts overlap from step to step.
STEP_BYTES = 1 << 21
GROUP_CONTEXTS = 20_000
#: Keys that occur again are broadcast up to this number (8 MB), beyond it shuffled.
BROADCAST_KEYS = 1 << 20
SHALLOW = 64


# ---------------------------------------------------------------- anchors

def _powers(x: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """Polynomial hashes of all substrings of 1, 2, 4, ... ``width`` bytes, by doubling."""
    h = {1: x.astype(np.uint64) + np.uint64(1)}
    b, w = np.array([BASE]), 1
    while w < width:
        h[2 * w] = h[w][:-w] * b + h[w][w:]
        b, w = b * b, 2 * w
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _span_hash(h: dict[int, np.ndarray], at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position in ``at``, put together from powers of two."""
    out = np.zeros(len(at), np.uint64)
    at = at.copy()
    for w in sorted(h, reverse=True):
        if size & w:
            out = out * BASE + _mixed(h[w][at])
            at += w
            size -= w
    return _mixed(out)


def anchors(data: bytes, ends: list[int], length: int) -> np.ndarray:
    """Rows ``(position, first window, last window, key)`` of the texts concatenated in ``data`` and
    ending at ``ends``: windows starting in [first, last] have their anchor at the position. Windows
    whose anchor lies at most ``length // 2`` from their start have one row with the hash of the
    bytes right of the anchor, the others one with that of the bytes left of it (its key is odd).
    ``data`` has at most ``2 * STEP_BYTES + length`` bytes."""
    n, half = len(data), length // 2
    if n < length:
        return np.zeros((0, 4), np.int64)
    x = np.frombuffer(data, np.uint8)
    h = _powers(x, 1 << (half.bit_length() - 1))
    # the hash's upper bits, then the position: the minimum is the leftmost smallest 16-gram; as many bits
    # for texts hashed together with few others as with many, or equal windows could differ in anchors
    bits = np.uint64((2 * STEP_BYTES + length).bit_length())
    low = (_mixed(h[GRAM]) >> bits << bits) | np.arange(n - GRAM + 1, dtype=np.uint64)
    width, w = length - GRAM + 1, 1
    while 2 * w <= width:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    if w < width:
        low = np.minimum(low[:n - length + 1], low[width - w:])
    at = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    begin = np.arange(n - length + 1)
    end_of = np.searchsorted(np.asarray(ends), begin, side="right")
    inside = begin + length <= np.asarray(ends)[np.minimum(end_of, len(ends) - 1)]
    right = at - begin <= half
    change = np.flatnonzero((np.diff(at) != 0) | (np.diff(inside) != 0) | (np.diff(right) != 0)) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change, [len(at)])) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    p, is_right = at[first], right[first]
    key = np.empty(len(p), np.uint64)
    key[is_right] = _span_hash(h, p[is_right], half) & ~np.uint64(1)
    key[~is_right] = _span_hash(h, p[~is_right] - half, half) | np.uint64(1)
    return np.stack((p, first, last, key.view(np.int64)), axis=1)


def _runs(texts: list[bytes], length: int) -> list[np.ndarray]:
    """``anchors`` of each text, with positions in the text. Short texts are hashed together, long
    ones in steps that overlap by a window."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    todo: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        ends = np.cumsum([len(t) for _, _, t in todo])
        rows = anchors(b"".join(t for _, _, t in todo), ends.tolist(), length)
        cut = np.searchsorted(rows[:, 1], np.concatenate(([0], ends)))
        for k, (i, offset, t) in enumerate(todo):
            part = rows[cut[k]:cut[k + 1]].copy()
            part[:, :3] += offset - (ends[k] - len(t))
            out[i].append(part)
        todo.clear()

    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), STEP_BYTES):
            part = t[at:at + STEP_BYTES + length - 1]
            todo.append((i, at, part))
            size += len(part)
            if size >= STEP_BYTES:
                flush()
                size = 0
    if todo:
        flush()
    return [np.concatenate(x) if x else np.zeros((0, 4), np.int64) for x in out]


# ---------------------------------------------------------------- deep-shallow sorting

def _lcp(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, which agree before ``at``."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (differ.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], rows: list[int], depth: int) -> list[tuple[int, int]]:
    """``rows`` of strings that agree before ``depth`` in sorted order, each with its common prefix with
    the row before it (the first: ``depth``). Inner nodes know only their depth and their branching
    byte; a new string goes down blindly to some leaf, one comparison with that leaf tells where it
    branches off, and it is inserted there."""
    leaf: list = [rows[0]]  # a leaf: [rows of one string]; a node: (depth, {byte or -1: child})
    root = leaf
    for r in rows[1:]:
        s = strings[r]
        node = root
        while isinstance(node, tuple):
            d, kids = node
            node = kids.get(s[d] if d < len(s) else -1) or next(iter(kids.values()))
        other = strings[node[0]]
        common = _lcp(s, other, depth)
        if common == len(s) == len(other):
            node.append(r)
            continue
        above, node, branch = None, root, None
        while isinstance(node, tuple) and node[0] < common:
            above, branch = node, s[node[0]]
            node = node[1][branch]
        mine = s[common] if common < len(s) else -1
        if isinstance(node, tuple) and node[0] == common:
            node[1][mine] = [r]
            continue
        theirs = other[common] if common < len(other) else -1
        new = (common, {theirs: node, mine: [r]})
        if above is None:
            root = new
        else:
            above[1][branch] = new
    out: list[tuple[int, int]] = []
    stack: list = [(root, depth)]
    while stack:
        node, common = stack.pop()
        if isinstance(node, tuple):
            d, kids = node
            for n, b in enumerate(sorted(kids, reverse=True)):
                stack.append((kids[b], d if n < len(kids) - 1 else common))
        else:
            out += [(r, common if n == 0 else len(strings[r])) for n, r in enumerate(node)]
    return out


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of ``strings`` and the common-prefix length of each with the one before it.

    Multikey quicksort on symbols of eight bytes goes ``SHALLOW`` bytes deep; what agrees so far is
    ordered by a blind trie."""
    order: list[int] = []
    lcps: list[int] = []
    todo: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) == 1 or depth >= SHALLOW:
            for n, (r, common) in enumerate(blind_trie(strings, rows, depth) if len(rows) > 1 else [(rows[0], depth)]):
                lcps.append(common if n else -1)
                order.append(r)
            continue
        pivot = strings[rows[len(rows) // 2]][depth:depth + 8]
        less, same, more = [], [], []
        for r in rows:
            s = strings[r][depth:depth + 8]
            (same if s == pivot else less if s < pivot else more).append(r)
        # a symbol cut short by the string's end is its last: only equal strings share it
        todo += [(part, d) for part, d in ((more, depth), (same, depth + 8 if len(pivot) == 8 else SHALLOW), (less, depth)) if part]
    for i in range(1, len(order)):
        if lcps[i] < 0:  # two quicksort parts meet here
            lcps[i] = _lcp(strings[order[i - 1]], strings[order[i]], 0)
    return order, lcps


def repeated_offsets(contexts: list[tuple[bytes, int, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each context ``(bytes, low, high, count)`` the offsets between anchor and window start, as
    ranges within [low, high], of windows that another occurrence equals. The bytes run from ``high``
    before the anchor to the end of the window at ``low``."""
    m = len(contexts)
    if m == 1:
        _, low, high, count = contexts[0]
        return [[(low, high)] if count > 1 else []]
    right = [c[high:] for c, _, high, _ in contexts]
    left = [c[:high][::-1] for c, _, high, _ in contexts]
    r_order, r_lcp = deep_shallow(right)
    l_order, l_lcp = deep_shallow(left)
    if m == 2:
        common = (max(length - r_lcp[1], contexts[0][1], contexts[1][1]), min(l_lcp[1], contexts[0][2], contexts[1][2]))
        return [[(low, high)] if count > 1 else [common] if common[0] <= common[1] else [] for _, low, high, count in contexts]
    low = np.array([c[1] for c in contexts])
    high = np.array([c[2] for c in contexts])
    count = np.array([c[3] for c in contexts])
    ro, lo = np.array(r_order), np.array(l_order)
    rl, ll = np.array(r_lcp), np.array(l_lcp)
    cuts = np.unique(np.concatenate((low, high + 1, length - rl[1:], ll[1:] + 1)))
    cuts = cuts[(cuts >= low.min()) & (cuts <= high.max())]
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    r_class, l_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for o, until in zip(cuts.tolist(), np.append(cuts[1:], high.max() + 1).tolist()):
        r_class[ro] = np.cumsum(np.concatenate(([False], rl[1:] < length - o)))
        l_class[lo] = np.cumsum(np.concatenate(([False], ll[1:] < o)))
        there = np.flatnonzero((low <= o) & (o <= high))
        _, which = np.unique(r_class[there] * m + l_class[there], return_inverse=True)
        for i in there[np.bincount(which, count[there])[which] > 1].tolist():
            if out[i] and out[i][-1][1] == o - 1:
                out[i][-1] = (out[i][-1][0], until - 1)
            else:
                out[i].append((o, until - 1))
    return out


# ---------------------------------------------------------------- Spark

_RANGES = "array<struct<lo:int,hi:int>>"
_RUN = "array<struct<p:bigint,lo:int,hi:int,key:bigint>>"


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """``(d, t, h)`` to ``(d, h, n_bytes, sha256, runs)``: the anchors of each text."""
    kind = docs.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("p", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(t.as_py() or "").encode() for t in part["t"]]
                runs = _runs(texts, length)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(c, k) for c, k in _run_columns(np.concatenate(runs))], names=["p", "lo", "hi", "key"]))
                yield pa.RecordBatch.from_arrays([
                    part["d"], part["h"], pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), lists.cast(run_type)], names=["d", "h", "n_bytes", "sha256", "runs"])

    return docs.mapInArrow(run, f"d {kind}, h bigint, n_bytes bigint, sha256 string, runs {_RUN}")


def _run_columns(rows: np.ndarray) -> list:
    p, first, last, key = rows.T
    return [(p, pa.int64()), (p - last, pa.int32()), (p - first, pa.int32()), (key, pa.int64())]


def _contexts(texts: DataFrame, kind: str, length: int) -> DataFrame:
    """``(d, h, t, runs)`` to a row for each run: ``(key, digest, d, h, p, lo, hi, context)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "digest", "d", "h", "p", "lo", "hi", "context"]
        kinds = [pa.int64(), pa.binary(), None, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            kinds[2] = batch.schema.field("d").type
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                t = batch["t"][i].as_py().encode()
                d, h = batch["d"][i].as_py(), batch["h"][i].as_py()
                for r in batch["runs"][i].as_py():
                    p, lo, hi = r["p"], r["lo"], r["hi"]
                    c = t[p - hi:p - lo + length]
                    rows.append((r["key"], hashlib.md5(b"%d " % hi + c).digest(), d, h, p, lo, hi, c))
                if len(rows) >= 4096 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names=names)
                    rows = []

    return texts.mapInArrow(run, f"key bigint, digest binary, d {kind}, h bigint, p bigint, lo int, hi int, context binary")


def _sorted_groups(contexts: DataFrame, length: int) -> DataFrame:
    """``(key, digest, lo, hi, n, context)``, partitioned and sorted by key, to ``(key, digest, ranges)``.
    Groups stream past one after the other; the largest has ``GROUP_CONTEXTS`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        done: list[tuple] = []

        def solve(key: int, group: list[tuple]) -> None:
            for (digest, *_), ranges in zip(group, repeated_offsets([(c, lo, hi, n) for _, lo, hi, n, c in group], length)):
                if ranges:
                    done.append((key, digest, [{"lo": a, "hi": b} for a, b in ranges]))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*done)) or [(), (), ()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], kind)], names=["key", "digest", "ranges"])

        last, group = None, []
        for batch in batches:
            for key, *row in zip(*[batch[c].to_pylist() for c in ("key", "digest", "lo", "hi", "n", "context")]):
                if key != last:
                    if group:
                        solve(last, group)
                    last, group = key, []
                group.append(tuple(row))
                if len(done) >= 4096:
                    yield batch_of()
        if group:
            solve(last, group)
        yield batch_of()

    return contexts.mapInArrow(run, f"key bigint, digest binary, ranges {_RANGES}")


def _counted_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same result for groups of any size: each window by its own SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, digest, lo, hi, n, c = (batch[x][i].as_py() for x in ("key", "digest", "lo", "hi", "n", "context"))
                size = hi - lo + 1
                shas = [hashlib.sha256(c[hi - o:hi - o + length]).digest()[:16] for o in range(lo, hi + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * size, pa.int64()), pa.array([digest] * size, pa.binary()), pa.array([n] * size, pa.int64()),
                                                  pa.array(range(lo, hi + 1), pa.int32()), pa.array(shas, pa.binary())], names=["key", "digest", "n", "o", "w"])

    windows = contexts.mapInArrow(run, "key bigint, digest binary, n bigint, o int, w binary")
    again = windows.groupBy("key", "o", "w").agg(F.sum("n").alias("n")).where("n > 1").drop("n")
    hit = windows.join(again, ["key", "o", "w"]).groupBy("key", "digest").agg(F.collect_list(F.struct(F.col("o").alias("lo"), F.col("o").alias("hi"))).alias("ranges"))
    return hit.select("key", "digest", F.col("ranges").cast(_RANGES))


def _tables(spark: SparkSession, docs: DataFrame, doc_id: str, text: str, length: int) -> tuple[DataFrame, DataFrame]:
    """All texts with their figures, ``(d, h, n_bytes, sha256)``, and those that hold a repeated window
    with the window ranges to remove: ``(d, h, t, spans)``."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("d"), t.alias("t"), F.xxhash64(t).alias("h"))
    kind = docs.schema[doc_id].dataType.simpleString()
    anchored = materialize(spark, _anchored(rows, length), "suffix-anchors")
    runs = anchored.select("d", "h", F.inline("runs"))
    # written, so that the join below has a plain exchange on either side and hot keys can be split
    again = materialize(spark, runs.groupBy("key").count().where("count > 1").select("key"), "suffix-again")
    if again.count() <= BROADCAST_KEYS:
        again = F.broadcast(again)
    flagged = runs.join(again, "key").groupBy("d", "h").agg(F.collect_list(F.struct("p", "lo", "hi", "key")).alias("runs"))
    # a text may have a repeated row: the runs of the group are those of each row, as often as there are rows
    flagged = flagged.select(F.col("d").alias("fd"), F.col("h").alias("fh"), F.array_distinct("runs").alias("runs"))
    meets = lambda x: x["d"].eqNullSafe(F.col("fd")) & (x["h"] == F.col("fh"))
    texts = materialize(spark, rows.join(flagged, meets(rows)).select("d", "h", "t", "runs"), "suffix-texts")
    members = materialize(spark, _contexts(texts, kind, length), "suffix-contexts")
    contexts = members.groupBy("key", "digest").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.count(F.lit(1)).alias("n"), F.first("context").alias("context"))
    sizes = members.select("key", "digest").distinct().groupBy("key").count().where(F.col("count") > GROUP_CONTEXTS).select("key")
    large = materialize(spark, sizes, "suffix-large")
    if large.isEmpty():
        ranges = _sorted_groups(contexts.repartition("key").sortWithinPartitions("key", "digest"), length)
    else:
        rest = contexts.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key", "digest")
        ranges = _sorted_groups(rest, length).unionByName(_counted_windows(contexts.join(large, "key", "left_semi"), length))
    spans = members.drop("context", "lo", "hi").join(ranges, ["key", "digest"]).select("d", "h", F.explode("ranges").alias("r"), "p")
    spans = spans.select(F.col("d").alias("sd"), F.col("h").alias("sh"), F.struct((F.col("p") - F.col("r.hi")).alias("begin"), (F.col("p") - F.col("r.lo") + length).alias("end")).alias("s"))
    spans = spans.groupBy("sd", "sh").agg(F.collect_set("s").alias("spans"))
    hit = texts.select("d", "h", "t").join(spans, texts["d"].eqNullSafe(F.col("sd")) & (texts["h"] == F.col("sh"))).select("d", "h", "t", "spans")
    return anchored.drop("runs"), hit


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["begin"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(hit: DataFrame) -> DataFrame:
    """``(d, h, t, spans)`` to ``(d, h, kept, n_removed, n_spans)``, ``kept`` being the bytes that stay."""
    kind = hit.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept, removed, n = [], [], []
                for t, spans in zip(part["t"], part["spans"]):
                    x, merged, pos, keep = t.as_py().encode(), _merged(spans.as_py()), 0, []
                    for a, b in merged:
                        keep.append(x[pos:a])
                        pos = b
                    kept.append(b"".join([*keep, x[pos:]]))
                    removed.append(sum(b - a for a, b in merged))
                    n.append(len(merged))
                yield pa.RecordBatch.from_arrays([part["d"], part["h"], pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(n, pa.int64())],
                                                 names=["d", "h", "kept", "n_removed", "n_spans"])

    return hit.mapInArrow(run, f"d {kind}, h bigint, kept binary, n_removed bigint, n_spans bigint")


def repeated_bytes(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for each row of ``docs``: every byte covered
    by a string of ``length`` bytes that also starts anywhere else is removed, judged on the input.

    Null and empty texts have no bytes; matches never cross rows; rows that repeat an id or a whole
    row are texts of their own; other columns are not read; an empty table gives an empty result.
    """
    rows, hit = _tables(spark, docs, doc_id, text, length)
    cut = _cut(hit).select(F.col("d").alias("cd"), F.col("h").alias("ch"), F.sha2("kept", 256).alias("kept"), "n_removed", "n_spans").dropDuplicates(["cd", "ch"])
    out = rows.join(cut, rows["d"].eqNullSafe(F.col("cd")) & (rows["h"] == F.col("ch")), "left")
    return out.select(F.col("d").alias(doc_id), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                      F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256"))


def remove_repeats(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``; of a character that is cut in two, no byte
    stays. Other columns and all rows pass through."""
    cols = docs.columns
    _, hit = _tables(spark, docs, doc_id, text, length)
    kept = _cut(hit).dropDuplicates(["d", "h"])
    names = [fresh(docs, f"__cut_{c}") for c in ("d", "h", "kept")]
    kept = kept.select(F.col("d").alias(names[0]), F.col("h").alias(names[1]), _valid(F.col("kept")).alias(names[2]))
    on = F.col(f"`{doc_id}`").eqNullSafe(F.col(names[0])) & (F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))) == F.col(names[1]))
    out = docs.join(kept, on, "left")
    return out.select(*[F.coalesce(names[2], F.col(f"`{text}`")).alias(c) if c == text else F.col(f"`{c}`") for c in cols])


def _valid(raw: Column) -> Column:
    """The bytes as text without those that are no whole character."""

    @F.arrow_udf("string")
    def valid(x: pa.Array) -> pa.Array:
        return pa.array([b.as_py().decode("utf-8", "ignore") for b in x], pa.string())

    return valid(raw)
