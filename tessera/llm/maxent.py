"""Language-model scores by a hashed maximum-entropy model.

A word's probability is that of its bucket given the words before it, times its smoothed share of
the bucket. Buckets are the most frequent words, one each, and for the others a hash of the word's
ending, which tells languages apart. The bucket is predicted in two softmax steps, first its class,
then the bucket within the class, from hashed features: the last word, the last two words, the word
two and the word three places back (skips), and a constant.

Word counts are summed by Spark over all training texts. The weights are trained by rounds of
distributed updates: in each round every task takes AdaGrad steps in sparse numpy batches over its
part of that round's texts, and the tasks' weights are averaged row by row in a shuffle.

The counts of frequent words are broadcast (``FREQUENT`` of them, whatever the data); the others'
occurrences are joined to the count table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, materialize

#: Words whose counts are broadcast (16 bytes each).
FREQUENT = 131_072
CLASSES = MEMBERS = 16
BUCKETS = CLASSES * MEMBERS
#: The most frequent words have a bucket of their own, endings share the rest.
OWN = 192
ENDINGS = BUCKETS - OWN
FEATURES = 4096
#: Hashed features of a token (last word, last two, two skips); both steps use all of them.
USED = 4
BATCH = 8192
ROUNDS = 2
RATE = 0.3
#: Different words that a task adds up before it hands the counts on.
REMEMBERED = 1_000_000
#: The end of a text as a token, a fixed hash.
END_KEY = np.uint64(0x2545F4914F6CDD1D)


#: Words are hashed as polynomials in BASE modulo 2^64, then mixed.
BASE = 0x9E3779B97F4A7C15
#: Texts are hashed together up to so many bytes; longer ones are cut between words.
STEP_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Hash and ending of every token of some texts, in numpy; the powers of the base are kept."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(2 * n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, ending and begin of each word of ``data``."""
        x = np.frombuffer(data, np.uint8)
        self._grow(len(x) + 1)
        space = np.concatenate(([True], _SPACE[x], [True]))
        edge = np.flatnonzero(space[1:] != space[:-1])
        begin, end = edge[::2], edge[1::2]
        terms = x.astype(np.uint64)
        terms += np.uint64(1)
        terms *= self.power[:len(x)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))
        h = (sums[end] - sums[begin]) * self.inverse[begin]
        last = x[end - 1].astype(np.int64)
        before = np.where(end - begin > 1, x[np.maximum(end, 2) - 2], 0).astype(np.int64)
        return _mixed(h), ((before * 256 + last) * 40503 % 65_521 % ENDINGS).astype(np.int32), begin

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and ending of all tokens of the texts, one end each, and the number of tokens of each."""
        parts: list[tuple[int, bytes]] = []
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            starts = np.cumsum([0] + [len(p) + 1 for _, p in parts[:-1]])
            h, ending, begin = self.words(b" ".join(p for _, p in parts))
            out.append((h, ending, np.array([i for i, _ in parts])[np.searchsorted(starts, begin, side="right") - 1]))
            parts.clear()

        size = 0
        for i, t in enumerate(texts):
            low = t.encode().translate(LOWER) if t else b""
            while low:
                cut = len(low)
                if cut > STEP_BYTES:
                    cut = max(low.rfind(b" ", 0, STEP_BYTES), low.rfind(b"\n", 0, STEP_BYTES))
                    cut = len(low) if cut <= 0 else cut  # a word that long is hashed whole
                parts.append((i, low[:cut]))
                size += cut
                low = low[cut:]
                if size >= STEP_BYTES:
                    flush()
                    size = 0
        if parts:
            flush()
        text = np.concatenate([o[2] for o in out]) if out else np.zeros(0, np.int64)
        sizes = np.bincount(text, minlength=len(texts)) + 1
        n = len(text) + len(texts)
        key, ending = np.full(n, END_KEY, np.uint64), np.zeros(n, np.int32)
        at = np.arange(len(text)) + text  # each text's end stands behind its words
        if out:
            key[at] = np.concatenate([o[0] for o in out])
            ending[at] = np.concatenate([o[1] for o in out])
        return key.view(np.int64), ending, sizes


class Frequent:
    """Counts and buckets of the frequent words in an open-addressing table that numpy probes."""

    BITS = 20

    def __init__(self, key: np.ndarray, count: np.ndarray, bucket: np.ndarray):
        key = key.view(np.uint64)
        size = (1 << self.BITS) + 64
        self.at = np.full(size, -1, np.int32)
        self.key, self.count, self.bucket = key, count, bucket
        self.probes = 0
        rest = np.arange(len(key))
        while len(rest):
            slot = (key[rest] >> np.uint64(64 - self.BITS)).astype(np.int64) + self.probes
            if slot.max() >= len(self.at):
                self.at = np.concatenate((self.at, np.full(64, -1, np.int32)))
            _, first = np.unique(slot, return_index=True)
            first = first[self.at[slot[first]] < 0]
            self.at[slot[first]] = rest[first]
            rest = np.delete(rest, first)
            self.probes += 1

    def find(self, key: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is not there."""
        h = key.view(np.uint64)
        out = np.full(len(h), -1, np.int32)
        if not len(self.key):
            return out
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        rest = None
        for k in range(self.probes):
            row = self.at[slot + k]
            hit = (row >= 0) & (self.key[np.maximum(row, 0)] == (h if rest is None else h[rest]))
            if rest is None:
                out[hit] = row[hit]
                rest = np.flatnonzero((row >= 0) & ~hit)  # a free slot ends the search
            else:
                out[rest[hit]] = row[hit]
                rest = rest[(row >= 0) & ~hit]
            if not len(rest):
                break
            slot = (h[rest] >> np.uint64(64 - self.BITS)).astype(np.int64)
        return out

    def look_up(self, key: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and count (zero: not among the frequent) of each token."""
        row = self.find(key)
        there = row >= 0
        if not len(self.key):
            return OWN + ending, np.zeros(len(key), np.int64)
        row = np.maximum(row, 0)
        return np.where(there, self.bucket[row], OWN + ending), np.where(there, self.count[row], 0)


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """``(w, ending, c)``: hash, ending and occurrences of every token of the texts. A task adds up what
    it has seen and hands it on when it holds ``REMEMBERED`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        key, ending, n = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                k, e, _ = hasher.tokens(batch.slice(at, 512)[0].to_pylist())
                k, own, c = np.unique(k, return_index=True, return_counts=True)
                key, first, back = np.unique(np.concatenate((key, k)), return_index=True, return_inverse=True)
                ending = np.concatenate((ending, e[own]))[first]
                n = np.bincount(back, np.concatenate((n, c)), len(key)).astype(np.int64)
                if len(key) > REMEMBERED:
                    yield _counts(key, ending, n)
                    key, ending, n = key[:0], ending[:0], n[:0]
        if len(key):
            yield _counts(key, ending, n)

    return docs.select(text).mapInArrow(run, "w bigint, ending int, c bigint").groupBy("w", "ending").agg(F.sum("c").alias("c"))


def _counts(key: np.ndarray, ending: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ending), pa.array(n)], names=["w", "ending", "c"])


@dataclass
class Model:
    """Weights with the outputs as rows, held column by column: those of a feature are one line of the processor's cache."""

    first: np.ndarray  # CLASSES x FEATURES
    second: np.ndarray  # MEMBERS x (FEATURES * CLASSES)

    @classmethod
    def empty(cls) -> Model:
        return cls(np.zeros((CLASSES, FEATURES), np.float32, order="F"), np.zeros((MEMBERS, FEATURES * CLASSES), np.float32, order="F"))


def features(key: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashed features, ``USED`` x tokens, of tokens of texts that stand one after the other; feature 0
    is kept for the constant."""
    h = key.view(np.uint64) ^ (key.view(np.uint64) >> np.uint64(29))
    n = len(h)
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    back = []
    for k in (1, 2, 3):
        b = np.full(n, 7, np.uint64)
        b[k:] = h[:max(0, n - k)]
        b[place < k] = 7  # before the text's first word
        back.append(b)
    last, skip, far = back
    out = np.empty((USED, n), np.uint16)
    for i, x in enumerate((last, last * np.uint64(0x9E3779B97F4A7C15) + skip, skip, far)):
        mixed = (x ^ np.uint64(i + 1)) * np.uint64(0xD6E8FEB86659FD93)
        out[i] = (mixed >> np.uint64(40)) % np.uint64(FEATURES - 1) + np.uint64(1)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def _probabilities(model: Model, f: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token's bucket, class probabilities and bucket probabilities within that class."""
    c = (bucket // MEMBERS).astype(np.uint16)
    first, second = model.first.T, model.second.T
    x, y = first.take(f[0], axis=0), second.take(f[0] * np.uint16(CLASSES) + c, axis=0)
    for i in range(1, USED):
        x += first.take(f[i], axis=0)
        y += second.take(f[i] * np.uint16(CLASSES) + c, axis=0)
    x += first[0]
    y += second.take(c, axis=0)
    x, y = (np.ascontiguousarray(z.T) for z in (x, y))  # outputs as rows: numpy sums them fastest this way
    return c, _softmax(x), _softmax(y)


def log_probability(model: Model, f: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Log10 probability of each token's bucket."""
    out = np.empty(len(bucket))
    for at in range(0, len(bucket), BATCH):
        part = slice(at, at + BATCH)
        c, p, q = _probabilities(model, f[:, part], bucket[part])
        n = np.arange(len(c))
        out[part] = np.log10(p[c, n] * q[bucket[part] % MEMBERS, n])
    return out


def _step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """AdaGrad step on the rows ``rows`` of weights that the batch touches, by one row of ``gradient`` each;
    ``squares`` has one sum for each row of weights."""
    order = np.argsort(rows, kind="stable")  # 16-bit numbers: a radix sort
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    g = np.add.reduceat(gradient.take(order, axis=0), first, axis=0)
    at = ordered[first].astype(np.intp)
    squares[at] += np.ascontiguousarray((g * g).T).mean(axis=0)
    weights[at] = weights.take(at, axis=0) - g * (RATE / (np.sqrt(squares[at]) + 1e-3))[:, None]


def train_batch(model: Model, squares: tuple[np.ndarray, np.ndarray], f: np.ndarray, bucket: np.ndarray) -> None:
    c, p, q = _probabilities(model, f, bucket)
    n = np.arange(len(c))
    p[c, n] -= 1
    q[bucket % MEMBERS, n] -= 1
    p_all, p, q = p.sum(axis=1)[None, :], np.ascontiguousarray(p.T), np.ascontiguousarray(q.T)
    for i in range(USED):
        _step(model.first.T, squares[0], f[i], p)
    _step(model.first.T, squares[0], np.zeros(1, np.uint16), p_all)
    for i in range(USED):
        _step(model.second.T, squares[1], f[i] * np.uint16(CLASSES) + c, q)
    _step(model.second.T, squares[1], c, q)


_FLOATS = pa.list_(pa.float32())


def train_round(spark: SparkSession, docs: DataFrame, text: str, model: Model, frequent) -> Model:
    """The average of the weights that each task reaches over its part of ``docs``, by rows: a row of
    weights is averaged over the tasks whose tokens touched it, by their number of tokens."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        own = Model(start.first.copy("F"), start.second.copy("F"))
        squares = np.zeros(own.first.shape[1], np.float32), np.zeros(own.second.shape[1], np.float32)
        hits = np.zeros(own.first.shape[1], np.int64), np.zeros(own.second.shape[1], np.int64)
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                key, ending, sizes = hasher.tokens(batch.slice(at, 256)[0].to_pylist())
                f, b = features(key, sizes), frequent.value.look_up(key, ending)[0]
                # neighbours are alike: a step takes tokens from all over the batch
                mixed = np.random.default_rng(len(key)).permutation(len(key))
                for k in range(0, len(key), BATCH):
                    part = mixed[k:k + BATCH]
                    train_batch(own, squares, f[:, part], b[part])
                c = (b // MEMBERS).astype(np.uint16)
                for i in range(USED):
                    hits[0][:] += np.bincount(f[i], minlength=FEATURES)
                for i in range(USED):
                    hits[1][:] += np.bincount(f[i] * np.uint16(CLASSES) + c, minlength=FEATURES * CLASSES)
                hits[0][0] += len(b)
                hits[1][:CLASSES] += np.bincount(c, minlength=CLASSES)
        for layer, (w, n) in enumerate(zip((own.first, own.second), hits)):
            used = np.flatnonzero(n)
            for at in range(0, len(used), 8192):
                r = used[at:at + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), layer, np.int32)), pa.array(r), pa.array(n[r].astype(np.float64)),
                                                  pa.array(list(w[:, r].T), _FLOATS)], names=["layer", "r", "n", "w"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a partition, in any order: sums by (layer, row)
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            n = batch["n"].to_numpy()
            w = np.array(batch["w"].values, np.float64).reshape(len(n), -1) * n[:, None]
            for k, size, row in zip(zip(batch["layer"].to_pylist(), batch["r"].to_pylist()), n, w):
                s = sums.setdefault(k, [0.0, 0.0])
                s[0] += size
                s[1] = s[1] + row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int64()),
                                              pa.array([s[1] / s[0] for s in sums.values()], _FLOATS)], names=["layer", "r", "w"])

    updates = docs.select(text).mapInArrow(run, "layer int, r bigint, n double, w array<float>")
    averaged = updates.repartition("layer", "r").mapInArrow(average, "layer int, r bigint, w array<float>")
    out = Model(model.first.copy("F"), model.second.copy("F"))
    for r in averaged.toLocalIterator():
        (out.second if r["layer"] else out.first)[:, r["r"]] = r["w"]
    return out


def _frequent(spark: SparkSession, counts: DataFrame) -> tuple:
    """Broadcast hash, count and bucket of the most frequent words (``FREQUENT`` at most, whole steps of
    a sixteenth of a doubling of the count), and N + V + 1 of every bucket."""
    step = F.floor(F.log2("c") * 16)
    steps = sorted(tuple(r) for r in counts.groupBy(step.alias("s")).count().toLocalIterator())
    least, n = None, 0
    for s, k in reversed(steps):
        n += k
        if n > FREQUENT:
            break
        least = s
    top = counts.where(step >= least if least is not None else F.lit(False)).toArrow()
    w, c, ending = (top[x].to_numpy().astype(np.int64) for x in ("w", "c", "ending"))
    by_count = np.lexsort((w, -c))
    bucket = OWN + ending
    bucket[by_count[:OWN]] = np.arange(min(OWN, len(w)))
    own = F.create_map(*[F.lit(int(x)) for i in by_count[:OWN] for x in (w[i], bucket[i])]) if len(w) else F.lit(None).cast("map<bigint,bigint>")
    mass = np.ones(BUCKETS)
    sizes = counts.groupBy(F.coalesce(F.try_element_at(own, F.col("w")), F.col("ending") + OWN).alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    for r in sizes.toLocalIterator():
        mass[r["b"]] += r["n"] + r["v"]
    return spark.sparkContext.broadcast(Frequent(w, c, bucket)), mass


def score(spark: SparkSession, docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``, with a
    model of the rows for which ``train`` holds.

    ``base_score``: sum over tokens (words and one end) of log10((c + 1) / (N + V + 1)) by training
    counts. ``score``: the model's log10 probability of the text; a word unknown in training takes the
    one count that smoothing adds to its bucket. Null and empty texts have the end alone; repeated
    rows are scored each; without training rows N is zero and all tokens are unknown; other columns
    are not read.
    """
    training = docs.where(train).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    counts = materialize(spark, count_words(training, "t"), "maxent-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent, mass = _frequent(spark, counts)
    model = Model.empty()
    for k in range(ROUNDS):
        part = training.where(F.pmod(F.xxhash64("d"), F.lit(ROUNDS)) == k)
        model = train_round(spark, part, "t", model, frequent)
    shared = spark.sparkContext.broadcast((model, np.log10(mass)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, log_mass = shared.value
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                key, ending, sizes = hasher.tokens(part["t"].to_pylist())
                bucket, count = frequent.value.look_up(key, ending)
                end = np.cumsum(sizes)
                begin = end - sizes
                model_part = np.add.reduceat(log_probability(m, features(key, sizes), bucket) - log_mass[bucket], begin)
                known = np.add.reduceat((count > 0).astype(np.int64), begin)
                logs = np.add.reduceat(np.log10(count + 1), begin)
                rare = count == 0
                cut = np.concatenate(([0], np.cumsum(np.add.reduceat(rare.astype(np.int64), begin))))
                yield pa.RecordBatch.from_arrays([
                    part["d"], pa.array(sizes), pa.array(known), pa.array(logs), pa.array(model_part),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(key[rare]))], names=["d", "n_tokens", "known", "logs", "model", "rare"])

    kind = docs.schema[doc_id].dataType.simpleString()
    scored = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, f"d {kind}, n_tokens bigint, known bigint, logs double, model double, rare array<bigint>")
    # the id is written with the row, so it is the same in every later pass
    scored = materialize(spark, scored.withColumn("row", F.monotonically_increasing_id()), "maxent-scored")
    rare = scored.select("row", F.explode("rare").alias("w")).join(counts.select("w", "c"), "w")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("rare_known"), F.sum(F.log10(F.col("c") + 1)).alias("rare_logs"))
    out = scored.drop("rare").join(rare, "row", "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    n, v = int(total[0]), int(total[1])
    return out.select(F.col("d").alias(doc_id), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                      (logs - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), (logs + F.col("model")).alias("score"))
