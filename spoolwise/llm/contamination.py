"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.scans import cut_lineage
from . import words as W

WIDTH = 10
BLOCK_BYTES = 32 << 20
"""Benchmark text searched for in one pass, and so the bound on what a pass broadcasts; more text takes more passes."""
_SPACE, _ROW = 32, 1
_TABLE = 20
_CLASSES = (8, 24, 1 << 62)
"""Patterns are searched in classes of length (bytes), so that one short item does not shorten every shift."""
_LANE = 768


def normalise(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words with one byte between them (``_ROW`` where a row begins), and where each word starts."""
    low = W.LOWER[buf]
    inside = ~W.SYMBOL[low]
    rows = offsets[1:-1]
    rows = rows[rows > 0]
    low = np.where(inside, low, np.uint8(_SPACE))
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    out = low[keep]
    place = np.cumsum(keep)
    # a mark at each row's beginning, so that no pattern runs over it, and at both ends
    marks = np.unique(np.concatenate(([0], place[rows - 1], [len(out)]))).astype(np.int64)
    out = np.insert(out, marks, _ROW)
    word = ~W.SYMBOL[out]
    start = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    return out, start


class _Class:
    """Wu-Manber tables for patterns of similar length."""

    def __init__(self, patterns: list[tuple[int, bytes]]):
        self.least = min(len(p) for _, p in patterns)
        self.block = max(1, min(5, self.least))
        self.shift = np.full(1 << _TABLE, self.least - self.block + 1, np.int32)
        self.bucket: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        heads = np.frombuffer(b"".join(p[: self.least] for _, p in patterns), np.uint8).reshape(len(patterns), self.least)
        for end in range(self.block - 1, self.least):
            code = self._code([heads[:, end - j] for j in range(self.block)])
            np.minimum.at(self.shift, code, self.least - 1 - end)
        suffix = self._code([heads[:, self.least - 1 - j] for j in range(self.block)])
        front = self._code([heads[:, j] for j in range(self.block)])
        for s, p in zip(suffix.tolist(), patterns):
            self.bucket[s].append(p)
        self.pairs = np.unique(suffix.astype(np.int64) << _TABLE | front)

    def _code(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - _TABLE)).astype(np.int64)

    def search(self, text: np.ndarray, raw: bytes) -> Iterator[tuple[int, int, int]]:
        """(start, pattern number, length) of every occurrence between two separators.

        Stretches of the text are walked side by side, each by its own shifts; a stretch owns the occurrences that
        start in it.
        """
        n, m = len(text), self.least
        if n < m:
            return
        begin = np.arange(0, n - m + 1, _LANE)
        limit = np.minimum(begin + _LANE, n - m + 1) + m - 1
        at, found, codes = begin + m - 1, [], []
        while len(at):
            code = self._code([text[at - j] for j in range(self.block)])
            step = self.shift[code]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
                codes.append(code[hit])
            at = at + np.maximum(step, 1)
            live = at < limit
            if not live.all():
                at, limit = at[live], limit[live]
        if not found:
            return
        start, code = np.concatenate(found) - (m - 1), np.concatenate(codes)
        inside = ~W.SYMBOL[text]
        front = self._code([text[start + j] for j in range(self.block)])
        key = code << _TABLE | front
        near = np.searchsorted(self.pairs, key)
        good = (self.pairs[np.minimum(near, len(self.pairs) - 1)] == key) & ~inside[start - 1]
        for s, c in zip(start[good].tolist(), code[good].tolist()):
            for number, p in self.bucket[c]:
                e = s + len(p)
                if raw[s:e] == p and not inside[e]:
                    yield s, number, len(p)


class Matcher:
    """Windows of ``width`` words of the items (an item of fewer words is one window), ready for search."""

    def __init__(self, items: Sequence[tuple[int, str]], width: int = WIDTH):
        owners: dict[bytes, set] = defaultdict(set)
        sizes: dict[bytes, int] = {}
        for item, text in items:
            buf = np.frombuffer((text or "").encode(), np.uint8)
            norm, start = normalise(buf, np.array([0, len(buf)]))
            if not len(start):
                continue
            parts = norm.tobytes()[1:-1].strip(b" \x01").split(b" ")
            k = min(width, len(parts))
            for n in range(len(parts) - k + 1):
                w = b" ".join(parts[n : n + k])
                owners[w].add(item)
                sizes[w] = k
        ordered = sorted(owners)
        self.items = [sorted(owners[w]) for w in ordered]
        self.sizes = [sizes[w] for w in ordered]
        grouped = defaultdict(list)
        for n, w in enumerate(ordered):
            grouped[next(i for i, top in enumerate(_CLASSES) if len(w) < top)].append((n, w))
        self.classes = [_Class(g) for g in grouped.values()]

    def slice(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set]]:
        """For the rows of a slice: the first word of each, which words are hit, and the items that occur."""
        text, start = normalise(buf, offsets)
        first = W.find_words(W.LOWER[buf], offsets, W.SYMBOL).first
        edge, items = np.zeros(len(start) + 1, np.int64), [set() for _ in range(len(offsets) - 1)]
        raw = text.tobytes()
        for c in self.classes:
            for s, number, _ in c.search(text, raw):
                w = int(np.searchsorted(start, s))
                edge[w] += 1
                edge[w + self.sizes[number]] -= 1
                items[int(np.searchsorted(first, w, "right")) - 1].update(self.items[number])
        return first, np.cumsum(edge[:-1]) > 0, items


_ADDED = [("n_words", pa.int64()), ("hit_spans", pa.list_(pa.list_(pa.int32()))), ("hit_items", pa.list_(pa.int64()))]
_ADDED_DDL = "n_words long, hit_spans array<array<int>>, hit_items array<long>"


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WIDTH, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` plus ``n_words``, ``hit_spans`` (word ranges [start, end) inside an occurrence of a benchmark window, not
    touching) and ``hit_items`` (ids of the items with an occurring window, ascending).

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. Null and empty texts have no words;
    null items are passed over; equal items all count; without items nothing is hit. Columns of ``docs`` pass through
    (those of the three added names are replaced). Searching takes no shuffle. The benchmark is read in blocks of at
    most ``block_bytes`` of text (or one longer item), one pass over ``docs`` each; only a block is held and broadcast.
    Item ids are whole numbers.
    """
    size = F.sum(F.octet_length(F.coalesce(F.col(item_text), F.lit(""))) + 16)
    total = benchmark.agg(size.alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    added = {n for n, _ in _ADDED}
    out = docs.drop(*added)
    for b in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == b) if blocks > 1 else benchmark
        rows = [(r[0], r[1]) for r in part.where(F.col(item).isNotNull()).select(item, item_text).toLocalIterator()]
        out = _one_pass(out, rows, text, width)
        if b + 1 < blocks:
            out = cut_lineage(out)
    return out


def _one_pass(docs: DataFrame, rows: list[tuple[int, str]], text: str, width: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    again = "n_words" in docs.columns
    kept = [f for f in docs.schema.fields if f.name not in {n for n, _ in _ADDED}]
    ddl = type(docs.schema)([*kept, *type(docs.schema).fromDDL(_ADDED_DDL).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, width)
        for batch in batches:
            counts, spans, items = [], [], []
            old = batch.column("hit_spans").to_pylist() if again else None
            seen = batch.column("hit_items").to_pylist() if again else None
            for a, b, buf, off in W.text_slices(batch.column(text)):
                first, hit, found = matcher.slice(buf, off)
                counts += np.diff(first).tolist()
                for i in range(b - a):
                    own = hit[first[i] : first[i + 1]]
                    if again and old[a + i]:
                        own = own.copy()
                        for s, e in old[a + i]:
                            own[s:e] = True
                    spans.append(np.stack(W.runs(own), 1).tolist() if own.any() else [])
                    items.append(sorted(found[i] | set(seen[a + i] if again else ())))
            columns = [batch.column(f.name) for f in kept]
            made = [pa.array(v, t) for v, (_, t) in zip((counts, spans, items), _ADDED)]
            yield pa.RecordBatch.from_arrays([*columns, *made], [*[f.name for f in kept], *[n for n, _ in _ADDED]])

    return docs.mapInArrow(run, ddl)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents with no word in an occurrence of a benchmark window, with their own columns."""
    added = [n for n, _ in _ADDED]
    return find_contamination(docs, benchmark, **options).where(F.size("hit_spans") == 0).select(*[c for c in docs.columns if c not in added])
