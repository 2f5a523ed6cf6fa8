import base64
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken

from odd_inputs import no_docs, odd_docs, odd_rows  # noqa: F401
from tessera.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def _encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_equals_tiktoken():
    random.seed(1)
    encoding, ranks = _encoding(), bpe.load_ranks(PATH)
    for _ in range(300):
        piece = "".join(random.choice("abehinorst éß漢🙂") for _ in range(random.randint(1, 60))).encode()
        assert bpe.merge(piece, ranks) == encoding._core_bpe.encode_single_piece(piece)


def test_long_piece_without_break():
    encoding, ranks = _encoding(), bpe.load_ranks(PATH)
    piece = (b"the" * 20_000) + b"a" * 20_000
    assert bpe.merge(piece, ranks) == encoding._core_bpe.encode_single_piece(piece)


def test_merge_prefers_the_leftmost_of_equal_ranks():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"aab": 3}
    assert bpe.merge(b"aaab", ranks) == [2, 0, 1]
    assert bpe.merge(b"aab", ranks) == [3]


def test_round_trip_of_odd_texts(odd_docs, odd_rows):
    encoding = _encoding()
    out = bpe.encode_decode(odd_docs, PATH, P.PATTERN)
    assert out.columns == odd_docs.columns + ["ids", "decoded"]
    got = Counter((r.doc_id, r.text, bytes(r.ids), bytes(r.decoded)) for r in out.collect())
    want = Counter((d, t, np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in odd_rows)
    assert got == want


def test_empty_table(no_docs):
    assert bpe.encode_decode(no_docs, PATH, P.PATTERN).count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    pieces = bpe._Pieces(bpe.load_ranks(PATH))
    ids = [pieces[f"word{k}"] for k in range(10)]
    assert len(pieces) <= 3 and ids == [bpe._Pieces(pieces.ranks)[f"word{k}"] for k in range(10)]
