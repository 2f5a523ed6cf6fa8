"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A pre-token's adjacent pairs are the leaves of a segment tree (16 children a node) that stores the
leftmost minimum rank. Each merge takes the root, joins two live neighbours and updates the at most three leaves it
touches, so a pre-token of n bytes costs O(n log n) however long it is. Pre-tokens repeat, hence
every task keeps a bounded cache of the ones it has merged.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import row_udf

#: Above every rank.
NO_RANK = 1 << 32
#: Children of a node of the segment tree: the minimum of so few is one call.
FAN = 16
#: Entries of a task's pre-token cache; it is emptied when full.
CACHE_ENTRIES = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 token bytes and rank per line (a bounded vocabulary)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the pair of lowest rank, leftmost first, until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, no_rank = len(piece), NO_RANK
    get = ranks.get
    none = no_rank * n  # keys are rank * n + position; those of pairs without a rank are not below
    leaves = [get(piece[i:i + 2], no_rank) * n + i for i in range(n - 1)]
    levels = [leaves]
    while len(levels[-1]) > FAN:
        low = levels[-1]
        levels.append([min(low[a:a + FAN]) for a in range(0, len(low), FAN)])
    top = levels[-1]
    end = list(range(1, n + 1))  # end[i]: where the live part that starts at i ends
    before = list(range(-1, n))  # before[i]: start of the live part that ends at i
    while top and (key := min(top)) < none:
        i = key % n
        j = end[i]
        k = end[j]
        end[i] = k
        before[k] = i
        if j < n - 1:
            leaves[j] = none
        leaves[i] = get(piece[i:end[k]], no_rank) * n if k < n else none
        leaves[i] += i
        h = before[i] if i else 0
        if i:
            leaves[h] = get(piece[h:k], no_rank) * n + h
        if top is not leaves:
            for x in {h, i, min(j, n - 2)}:
                for low, high in zip(levels, levels[1:]):
                    x //= FAN
                    least = min(low[x * FAN:x * FAN + FAN])
                    if high[x] == least:
                        break
                    high[x] = least
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class _Pieces(dict):
    """Pre-token -> its ids as little-endian uint32 bytes, merged on first use; bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.code = {r: r.to_bytes(4, "little") for r in ranks.values()}.__getitem__

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join(map(self.code, merge(piece.encode(), self.ranks)))
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[piece] = ids
        return ids


def _vocabulary(spark, path: str):
    """The rank file is read on the driver (its place is a parameter) and broadcast: at most a few
    hundred thousand short tokens, whatever the size of the data."""
    return spark.sparkContext.broadcast(load_ranks(path))


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> Column:
    """Column of token ids (binary, little-endian uint32) of ``text``; null and empty texts give
    empty binaries. Every match of ``pattern`` is encoded on its own, without special tokens."""
    ranks = _vocabulary(df.sparkSession, vocabulary)

    def start() -> Callable[[str | None], bytes]:
        import regex

        find = regex.compile(pattern).findall
        of = _Pieces(ranks.value).__getitem__
        return lambda t: b"".join(map(of, find(t))) if t else b""

    return row_udf("binary", start)(F.col(text))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> Column:
    """Column of the bytes that ``ids`` (see ``encode``) stand for; null gives an empty binary."""
    ranks = _vocabulary(df.sparkSession, vocabulary)

    def start() -> Callable[[bytes | None], bytes]:
        token = {r: b for b, r in ranks.value.items()}.__getitem__
        return lambda t: b"".join(map(token, np.frombuffer(t, "<u4").tolist())) if t else b""

    return row_udf("binary", start)(F.col(ids))


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary) and ``decoded`` (binary) added, replacing columns so named.

    Rows are kept one to one, repeated rows included; null and empty texts have no ids; an empty
    table stays empty. Texts are handled one by one, so a long text costs memory for itself only.
    """
    out = docs.withColumn("ids", encode(docs, vocabulary, pattern, text))
    return out.withColumn("decoded", decode(out, vocabulary))
