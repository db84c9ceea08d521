"""Words, word hashes and windows of Arrow text batches, worked out on whole byte buffers.

Everything here runs inside a task on a slice of at most ``SLICE`` bytes of text (one text may be longer), so memory
does not depend on the partition. Hashes are 64 bits: words by a polynomial over random byte values, windows by a
polynomial over word hashes, both as differences of prefix sums, so the cost per byte does not depend on the width.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
"""Separators of words ``[^\\x20\\x09-\\x0D]+``."""
SYMBOL = np.ones(256, bool)
SYMBOL[ord("0"):ord("9") + 1] = SYMBOL[ord("a"):ord("z") + 1] = False
SYMBOL[128:] = False
"""Separators of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different salts give independent values."""
    x = x + np.uint64((salt * _BASES[0] + 0x1234567) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        # bytes of a slice fill it; words are fewer, so their powers grow as needed
        size = SLICE + 4096 if which == 0 and n <= SLICE + 4096 else 1 << max(16, (n - 1).bit_length())
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 4 * SLICE:
            _POWERS[which] = have
    return have


def _prefix(values: np.ndarray, which: int) -> np.ndarray:
    up, _ = _powers(which, len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    _, down = _powers(which, len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def row_ranges(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each, or one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of slices of a text column; null counts as empty."""
    gc.collect()  # a task's functions, with the tables they hold, refer to themselves and stay until they are looked for
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for a, b in row_ranges(offsets):
        yield a, b, whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
    release()


def release() -> None:
    """Give freed memory back to the machine: workers are kept between tasks and stages, and so would be what they held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@dataclass
class Words:
    """Words of some rows: byte ``start`` and ``end``, and ``first[i]``, the number of the first word of row i."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        prefix = _prefix(_BYTE[self.buf], 0)
        return mix(span_hashes(prefix, self.start, self.end, 0) + (self.end - self.start).astype(np.uint64))


def find_words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    inside = ~separators[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if len(buf):
        before[offsets[:-1][offsets[:-1] < len(buf)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(buf, start, end, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, first: np.ndarray, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, and whether they all belong to one row."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    which = 1 + salt % 2
    prefix = _prefix(mix(hashes, salt) if salt else hashes, which)
    at = np.arange(n - width + 1)
    row_end = np.repeat(first[1:], np.diff(first))
    return mix(span_hashes(prefix, at, at + width, which), salt + 7), at + width <= row_end[: n - width + 1]


def cover(marks: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``width`` that starts at one of ``marks``."""
    edge = np.zeros(n + width + 1, np.int64)
    np.add.at(edge, marks, 1)
    np.add.at(edge, marks + width, -1)
    return np.cumsum(edge[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def content_keys(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of content address for each row of a slice."""
    import hashlib

    view = memoryview(np.ascontiguousarray(buf))
    raw = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:]))
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it differ from all ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out
