import random

import numpy as np
import pytest

from spoolwise.llm import pieces
from spoolwise.llm.registry import PIECE_MODEL

PARTS = ["th", "er", "日", "é", "\u0001", "ing", "s", "tion", "🙂", " ", "  ", "\0", "\n", "ß", "\x7f", "X", "▁"]


def slice_of(rows):
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])


def expected(model, rows):
    """Piece numbers of each row, every word by the walk that keeps one position at a time."""
    return [[n for w in model.words(r.replace("▁".encode(), b" ").decode("utf-8", "replace")) for n in model.encode_long(w)] for r in rows]


@pytest.mark.parametrize("cache", [0, 20_000, 32 << 20])
def test_words_side_by_side(monkeypatch, cache):
    """Rows with odd characters, bytes that are no UTF-8 (also such as only two rows together make whole), long words."""
    monkeypatch.setattr(pieces, "CACHE_BYTES", cache)
    monkeypatch.setattr(pieces, "_TRIE", 500)
    encoder, model, rng = pieces.Encoder(PIECE_MODEL), pieces.Pieces(PIECE_MODEL), random.Random(4)
    for turn in range(6):
        rows = ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 8, 60]))).encode() for _ in range(30)]
        rows += [b"a\xe6", b"\x97\xa5 b", b"\xed\xa0\x80", b"\xff"] if turn % 2 else ["日".encode() * 500, b" " * 1500]
        ids, edge = encoder.slice(*slice_of(rows))
        assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])] == expected(model, rows)


def test_short_words_take_no_step_by_character(monkeypatch):
    def never(*_):
        raise AssertionError("a word was walked by itself")

    encoder, model = pieces.Encoder(PIECE_MODEL), pieces.Pieces(PIECE_MODEL)
    rows = [" ".join(f"thon{i}tion" for i in range(200)).encode(), "été 日本 \u0001".encode()]
    want = expected(model, rows)
    monkeypatch.setattr(pieces.Pieces, "_step", never)
    ids, edge = encoder.slice(*slice_of(rows))
    assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])] == want
