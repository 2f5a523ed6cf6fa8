"""Fill-in-the-middle transformation with cuts found by arithmetic on 64-bit words.

A unit is a run of ASCII letters or one other code point. The UTF-8 bytes of a text are viewed as
uint64; in each word the bytes that end a unit are marked by arithmetic on all eight bytes at once,
``bitwise_count`` counts the marks, the word that holds a wanted unit end is found by binary search in
the cumulative counts, and the byte inside that word by a select on its eight prefix counts.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ROWS_AT_ONCE, fresh

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

_KIND = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"
_BYTE = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_ONE, _SEVEN, _EIGHT, _FULL = np.uint64(1), np.uint64(7), np.uint64(8), np.uint64(56)


def _each(value: int) -> np.uint64:
    return np.uint64(value * 0x0101010101010101)


_CASE, _FROM_A, _PAST_Z = _each(0x20), _each(0x80 - 0x61), _each(0x80 - 0x7B)


def _words(data: bytes) -> np.ndarray:
    """The bytes as little-endian words, zeros behind, and one word of zeros at the end."""
    return np.frombuffer(data + bytes(16 - len(data) % 8), "<u8")


def _letters(w: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is an ASCII letter. No sum leaves its byte: the addends are below 0x80."""
    low = (w | _CASE) & _LOW7
    return (low + _FROM_A) & ~(low + _PAST_Z) & ~w & _HIGH


def _continued(w: np.ndarray) -> np.ndarray:
    """The high bit of each byte that goes on with a code point (10xxxxxx)."""
    return w & (~w << _ONE) & _HIGH


def _next(marks: np.ndarray) -> np.ndarray:
    """The marks of the following bytes."""
    return (marks[:-1] >> _EIGHT) | (marks[1:] << _FULL)


class Units:
    """Unit ends of one text: ``n`` of them; ``end(k)`` is the byte behind the k-th, ``chars(b)`` the code points before byte b."""

    def __init__(self, data: bytes):
        w = _words(data)
        letters, goes_on = _letters(w), _continued(w)
        # a byte ends its unit unless a letter follows a letter or the code point goes on
        ends = ~((letters[:-1] & _next(letters)) | _next(goes_on)) & _HIGH
        self.size = len(data)
        used = -(-self.size // 8)
        self.ends, self.starts = ends[:used], ~goes_on[:used] & _HIGH
        if self.size % 8:  # bytes behind the text end nothing
            self.ends[-1] &= ~np.uint64(0) >> np.uint64(64 - 8 * (self.size % 8))
        self.total = np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)
        self.n = int(self.total[-1]) if used else 0

    def end(self, k: int) -> int:
        if k == 0:
            return 0
        at = int(np.searchsorted(self.total, k))
        rank = k - (int(self.total[at - 1]) if at else 0)
        seen = (self.ends[at:at + 1] >> _SEVEN) * _BYTE  # byte j: marks in the bytes up to j
        short = ~((seen | _HIGH) - _each(rank)) & _HIGH  # bytes that have seen fewer than rank
        return 8 * at + int(np.bitwise_count(short)[0]) + 1

    def chars(self, end: int) -> int:
        whole, rest = divmod(end, 8)
        n = int(np.bitwise_count(self.starts[:whole]).sum(dtype=np.int64))
        return n + (int(np.bitwise_count(self.starts[whole] & (~np.uint64(0) >> np.uint64(64 - 8 * rest)))) if rest else 0)


def transform_text(text: str | None, key: str, rate: int = 90, suffix_first: int = 20, marks: tuple[str, str, str] = MARKS) -> dict:
    """One text by the numbers that the SHA-256 of ``key`` gives: two cuts, whether to cut, which order."""
    data = (text or "").encode()
    units = Units(data)
    h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(key.encode()).digest()[:16])
    p, s, m = (x.encode() for x in marks)
    if not data or h3 % 100 >= rate or any(x in data for x in (p, s, m)):
        return {"n": units.n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text or ""}
    a, b = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.end(a), units.end(b)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    spm = h4 % 100 < suffix_first
    out = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    before = units.chars(a)
    return {"n": units.n, "form": "spm" if spm else "psm", "prefix_chars": before, "middle_chars": units.chars(b) - before, "output": out.decode()}


def restore_text(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text that ``output`` was made from. No mark stands in a cut text, and none can arise where
    a part meets a mark (no end of a mark is the beginning of one), so the first found is the one set."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (p, s) if form == "psm" else (s, p)
    one, rest = output[len(first):].split(second, 1)
    two, middle = rest.split(m, 1)
    return one + middle + two if form == "psm" else two + middle + one


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salt: int = 1, rate: int = 90,
              suffix_first: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``docs`` with a struct column ``fim`` (n, form, prefix_chars, middle_chars, output).

    Form is ``plain`` (unchanged: empty text, a mark in the text, or not drawn by ``rate`` of 100), ``psm`` or,
    for ``suffix_first`` of 100 drawn texts, ``spm``. All draws follow from the SHA-256 of ``salt:doc_id``, so a
    lost task repeats them and repeated rows get equal outputs. Null texts count as empty; a null id draws as the
    empty id; other columns stay, one called ``fim`` is replaced; an empty table gives an empty result. Texts
    are cut whole, one at a time. Marks must be distinct, and no end of one may begin another.
    """
    if len(set(marks)) < 3 or any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b))):
        raise ValueError("marks must be distinct, and no end of one may be the beginning of another")

    @F.arrow_udf(_KIND)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        for texts, keys in batches:
            for at in range(0, len(texts), ROWS_AT_ONCE):
                rows = zip(texts.slice(at, ROWS_AT_ONCE), keys.slice(at, ROWS_AT_ONCE))
                yield pa.array([transform_text(t.as_py(), k.as_py(), rate, suffix_first, marks) for t, k in rows], type=kind)

    key = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    return docs.withColumn("fim", run(F.col(f"`{text}`"), key))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The original text, from a transformed text and its form, by built-in string functions."""
    p, s, m = marks
    before = F.substring_index(output, m, 1)  # the middle is all behind the first middle mark

    def halves(first: str, second: str) -> tuple[Column, Column]:
        head = F.substring_index(before, second, 1)
        return _from(head, F.lit(len(first))), _from(before, F.length(head) + len(second))

    prefix, suffix = halves(p, s)
    late, early = halves(s, p)
    middle = _from(output, F.length(before) + len(m))
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, middle, late)).otherwise(output)


def _from(c: Column, skipped: Column) -> Column:
    return F.substring(c, skipped + 1, F.length(c))


def with_restored(out: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The result of ``transform`` with the rebuilt text in a column ``restored`` (another name if taken)."""
    return out.withColumn(fresh(out, "restored"), restore(F.col("fim.output"), F.col("fim.form"), marks))
