"""Sketches of 64-bit keys: made in each task, merged slice by slice, and small by a stated bound.

A task sends its cells by slices of the key space; a slice is merged as a stream by one task, so merging needs the
memory of a slice whatever the number of tasks. What reaches the driver has ``2**bits`` cells, a parameter with a
ceiling; a sketch that is too small for its input only estimates higher.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import mix

SLICES = 256
FLUSH = 4 << 20
"""Keys that a task holds before it sends what it has."""
HOT = 64
"""A cell that one task counted so often, or that so many tasks counted, is hot."""
_PART = "slice int, once binary, often binary, hot binary"
Keys = Callable[[pa.RecordBatch], Iterable[np.ndarray]]


def bits_for(keys: float, least: int, most: int, room: int = 8) -> int:
    """Bits of a sketch with ``room`` cells for each key, inside its bounds."""
    return int(np.clip(np.ceil(np.log2(max(1.0, keys * room))), least, most))


def cells(keys: np.ndarray, depth: int, bits: int) -> np.ndarray:
    return (mix(keys, 101 + depth) >> np.uint64(64 - bits)).astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    s, *parts = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), *[pa.array(p, pa.binary()) for p in parts]], ["slice", "once", "often", "hot"])


def _flushes(batches: Iterator[pa.RecordBatch], keys_of: Keys) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in batches:
        for keys in keys_of(batch):
            held.append(keys)
            n += len(keys)
            if n >= FLUSH:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def repeated(df: DataFrame, keys_of: Keys, bits: int, depth: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """For each depth ``2**bits`` packed bits, cells that were counted twice or more; and the first depth's hot cells.

    A count-min sketch whose counters stop at two: a key that occurs twice has its bit set at every depth.
    """
    low = bits - SLICES.bit_length() + 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _flushes(batches, keys_of):
            rows = []
            for d in range(depth):
                at, n = np.unique(cells(keys, d, bits), return_counts=True)
                edge = np.searchsorted(at, np.arange(SLICES + 1, dtype=np.int64) << low)
                for s in range(SLICES):
                    own, count = at[edge[s] : edge[s + 1]], n[edge[s] : edge[s + 1]]
                    if len(own):
                        own = (own & ((1 << low) - 1)).astype(np.uint32)
                        rows.append((d * SLICES + s, own.tobytes(), own[count > 1].tobytes(), b"" if d else own[count >= HOT].tobytes()))
            yield _batch(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, once, often, hot in zip(*(batch.column(i).to_pylist() for i in range(4))):
                tasks, two = have.setdefault(s, (np.zeros(1 << low, np.uint8), np.zeros(1 << low, bool)))
                at = np.frombuffer(once, np.uint32)
                two[at] |= tasks[at] > 0
                tasks[at] = np.minimum(tasks[at], HOT - 1) + 1
                two[np.frombuffer(often, np.uint32)] = True
                tasks[np.frombuffer(hot, np.uint32)] = HOT
        yield _batch([(s, b"", np.packbits(two).tobytes(), b"" if s >= SLICES else np.packbits(tasks == HOT).tobytes()) for s, (tasks, two) in have.items()])

    out, hot = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(depth)], np.zeros((1 << bits) // 8, np.uint8)
    step = (1 << bits) // 8 // SLICES
    for s, _, packed, hot_packed in _collect(df, parts, merge):
        d, s = divmod(s, SLICES)
        out[d][s * step : (s + 1) * step] = np.frombuffer(packed, np.uint8)
        if not d:
            hot[s * step : (s + 1) * step] = np.frombuffer(hot_packed, np.uint8)
    return out, hot


def any_repeated(bitmaps: list[np.ndarray], keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether each key is estimated to occur at least twice."""
    out = np.ones(len(keys), bool)
    for d, packed in enumerate(bitmaps):
        at = cells(keys, d, bits)
        out &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def present(df: DataFrame, keys_of: Keys, bits: int) -> np.ndarray:
    """``2**bits`` packed bits of the keys that occur (a filter with false positives and no misses)."""
    twice = lambda batch: (np.repeat(k, 2) for k in keys_of(batch))
    return repeated(df, twice, bits, 1)[0][0]


def ranks(df: DataFrame, keys_of: Keys, bits: int) -> np.ndarray:
    """``2**bits`` bytes: the logarithm of how often a cell's keys occur, a frequency rank for every key.

    A task counts a cell up to 255 times; ranks only order keys, and beyond that all are frequent.
    """
    size = (1 << bits) // SLICES

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint8)
        for keys in _flushes(batches, keys_of):
            at, n = np.unique(cells(keys, 0, bits), return_counts=True)
            total[at] += np.minimum(n, 255 - total[at]).astype(np.uint8)
        if total.any():
            yield _batch([(s, zlib.compress(total[s * size : (s + 1) * size].tobytes(), 1), b"", b"") for s in range(SLICES)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                have.setdefault(s, np.zeros(size, np.uint64))[:] += np.frombuffer(zlib.decompress(packed), np.uint8)
        yield _batch([(s, np.floor(np.log2(n.astype(np.float64) + 1)).astype(np.uint8).tobytes(), b"", b"") for s, n in have.items()])

    out = np.zeros(1 << bits, np.uint8)
    for s, r, _, _ in _collect(df, parts, merge):
        out[s * size : (s + 1) * size] = np.frombuffer(r, np.uint8)
    return out


def _collect(df: DataFrame, parts: Callable, merge: Callable) -> list:
    return df.mapInArrow(parts, _PART).repartition("slice").mapInArrow(merge, _PART).collect()
