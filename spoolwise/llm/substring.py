"""Substring dedup: a count-min prefilter over all windows, then exact grouping of the windows it cannot rule out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from . import sketch, words as W

WIDTH = 35
GRAM = 8
MAX_BITS = 29
"""Ceiling of the sketch: ``2**MAX_BITS`` bits at each of two depths, 64 MB each."""
HELD = 1 << 20
"""Windows that a task compares among themselves before it sends them on."""


def anchors(hashes: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams' hashes, the place of each window's anchor, and whether the window lies in one text.

    The anchor is the leftmost of the window's least grams. Equal windows have equal anchors at equal places inside
    them, so the number of anchor places with one gram is never below the number of windows with one word sequence:
    counting places (about one in fourteen words) overestimates the windows, as the sketch does too.
    """
    grams, _ = W.windows(hashes, first, gram, 3)
    _, inside = W.windows(hashes, first, width)
    reach, n = width - gram + 1, len(hashes) - width + 1
    if n <= 0:
        return grams, np.zeros(0, np.int64), np.zeros(0, bool)
    least, at, span = grams, np.arange(len(grams)), 1

    def lesser(shift: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = least[:size], least[shift : shift + size]
        take = b < a
        return np.where(take, b, a), np.where(take, at[shift : shift + size], at[:size])

    while span * 2 <= reach:
        least, at = lesser(span, len(least) - span)
        span *= 2
    if span < reach:
        least, at = lesser(reach - span, n)
    return grams, at[:n], inside


def _anchor_keys(text: str, width: int, gram: int):
    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, buf, off in W.text_slices(batch.column(text)):
            w = W.find_words(buf, off, W.SPACE)
            grams, at, inside = anchors(w.hashes(), w.first, width, gram)
            at = at[inside]
            if len(at):
                yield grams[at[np.concatenate(([True], at[1:] != at[:-1]))]]

    return keys


_ROWS = "key long, t1 long, t2 long, at int, hashes binary, many binary, spans binary"
_FOUND = "t1 long, t2 long, starts binary, spans binary"


def _binary(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Stretches of ``values`` between the edges as binary values."""
    off = (edge * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _suspects(text: str, width: int, gram: int, bits: int, sketches):
    """Windows whose anchor may be repeated, in runs that share an anchor: one row for about fourteen windows.

    Rows meet by their anchor's gram; a hot gram's windows meet one by one, each by its own hash, so that a phrase which
    stands in many contexts isn't gathered. Windows that are equal inside the task are settled here and sent once, so a
    window that stands in a third of all texts is one row a task.
    """
    schema = pa.schema([("key", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("at", pa.int32()), ("hashes", pa.binary()),
                        ("many", pa.binary()), ("spans", pa.binary())])

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        one, key, hot, t1, t2, at, anchor = (np.concatenate([h[i] for h in held]) for i in range(7))
        order = np.lexsort((key, one))
        new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (key[order][1:] != key[order][:-1])))
        size = np.diff(np.concatenate((np.flatnonzero(new), [len(one)])))
        many = np.zeros(len(one), bool)
        many[order] = np.repeat(size > 1, size)
        send = np.sort(order[new])
        n1, n2, na, nh = t1[send], t2[send], at[send], hot[send]
        cut = np.ones(len(send), bool)
        cut[1:] = (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1]) | (na[1:] != na[:-1] + 1) | (anchor[send][1:] != anchor[send][:-1]) | nh[1:]
        run = np.flatnonzero(cut)
        edge = np.append(run, len(send))
        keys = np.where(nh, W.mix(one[send].view(np.uint64), 9).view(np.int64), key[send])[run]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(n1[run]), pa.array(n2[run]), pa.array(na[run]), _binary(one[send], edge), _binary(many[send].view(np.uint8), edge),
             pa.nulls(len(run), pa.binary())], schema=schema)
        if many.any():
            a, b, starts = _by_text(t1[many], t2[many], at[many])
            none = pa.nulls(len(a), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int32)), none, none, pa.array([_pack(s, width) for s in starts], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        bitmaps, hot_bits = sketches.value
        for batch in batches:
            t1, t2 = (batch.column(c).to_numpy() for c in ("t1", "t2"))
            for a, b, buf, off in W.text_slices(batch.column(text)):
                w = W.find_words(buf, off, W.SPACE)
                hashes = w.hashes()
                grams, at, inside = anchors(hashes, w.first, width, gram)
                if not inside.any():
                    continue
                places = np.unique(at[inside])
                open_, hot = np.zeros(len(grams), bool), np.zeros(len(grams), bool)
                open_[places] = sketch.any_repeated(bitmaps, grams[places], bits)
                hot[places] = sketch.any_repeated([hot_bits], grams[places], bits)
                pick = np.flatnonzero(inside & open_[at])
                if not len(pick):
                    continue
                row = np.searchsorted(w.first, pick, "right") - 1
                own = at[pick]
                one = W.windows(hashes, w.first, width, 4)[0][pick]
                held.append((one.view(np.int64), grams[own].view(np.int64), hot[own], t1[a + row], t2[a + row], (pick - w.first[row]).astype(np.int32), own - w.first[row]))
                n += len(pick)
                if n >= HELD:
                    yield from settle(held)
                    held, n = [], 0
        if n:
            yield from settle(held)

    return run


def _by_text(t1: np.ndarray, t2: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Texts and the ascending starts marked in each, once however many copies of the text marked them."""
    order = np.lexsort((at, t2, t1))
    t1, t2, at = t1[order], t2[order], at[order]
    once = np.ones(len(at), bool)
    once[1:] = (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]) | (at[1:] != at[:-1])
    t1, t2, at = t1[once], t2[once], at[once]
    new = np.flatnonzero(np.concatenate(([True], (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]))))
    return t1[new], t2[new], np.split(at, new[1:])


def _pack(starts: np.ndarray, width: int) -> bytes:
    """Ascending window starts as ranges of covered words."""
    cut = np.flatnonzero(np.diff(starts) > width)
    return np.stack((np.concatenate((starts[:1], starts[cut + 1])), np.concatenate((starts[cut], starts[-1:])) + width), 1).astype(np.int32).tobytes()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: windows with one key and one hash are repeated, wherever they stand."""
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("starts", pa.binary()), ("spans", pa.binary())])
    names = ("key", "t1", "t2", "at", "hashes", "many")
    rest: list[pa.RecordBatch] = []
    held, n = [], 0

    def marks(held: list) -> pa.RecordBatch:
        a, b, starts = _by_text(*(np.concatenate([h[i] for h in held]) for i in range(3)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([s.tobytes() for s in starts], pa.binary()), pa.nulls(len(a), pa.binary())], schema=schema)

    def settle(rows: pa.Table) -> tuple:
        key, t1, t2, at = (rows.column(c).to_numpy() for c in names[:4])
        runs_ = rows.column("hashes").to_pylist()
        size = np.fromiter((len(r) // 8 for r in runs_), np.int64, len(runs_))
        one = np.frombuffer(b"".join(runs_), np.int64)
        many = np.frombuffer(b"".join(rows.column("many").to_pylist()), np.uint8) > 0
        row = np.repeat(np.arange(len(size)), size)
        start = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        order = np.lexsort((key[row], one))
        k, o = key[row][order], one[order]
        new = np.concatenate(([True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])))
        count = np.diff(np.concatenate((np.flatnonzero(new), [len(o)])))
        mark = np.zeros(len(o), bool)
        mark[order] = np.repeat(count > 1, count)
        mark &= ~many
        return t1[row][mark], t2[row][mark], start[mark].astype(np.int32)

    def whole(last: bool) -> Iterator[pa.Table]:
        """What is held, up to the key that may go on in the next batch."""
        table = pa.Table.from_batches(rest)
        key = table.column("key").to_numpy()
        upto = len(key) if last else int(np.searchsorted(key, key[-1]))
        rest[:] = table.slice(upto).combine_chunks().to_batches()
        if upto:
            yield table.slice(0, upto)

    for batch in batches:
        ready = batch.column("spans").is_valid()
        done = batch.filter(ready)
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([done.column("t1"), done.column("t2"), pa.nulls(done.num_rows, pa.binary()), done.column("spans")], schema=schema)
        if done.num_rows < batch.num_rows:
            rest.append(batch.filter(pc.invert(ready)).select(list(names)))
            for rows in whole(False):
                held.append(settle(rows))
                n += len(held[-1][0])
        if n >= HELD:
            yield marks(held)
            held, n = [], 0
    if rest:
        for rows in whole(True):
            held.append(settle(rows))
            n += len(held[-1][0])
    if n:
        yield marks(held)


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, gram: int = GRAM, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_removed`` and ``kept``: its words, joined by one space, without each word covered
    by a window of ``width`` words that also starts anywhere else in ``docs``, the same text included.

    Words are runs of anything but white space (space, tab to carriage return). Null and empty texts have no words and
    keep ''; texts shorter than a window keep all; copies lose all their windows; repeated rows are copies. Other
    columns pass through (the three added names are replaced).

    First pass: a sketch of anchors, merged from all tasks; its width follows the input up to ``max_bits``. Second
    pass: windows that the sketch cannot rule out are grouped exactly, by 128 bits (of the anchor's words and of all). A sketch that is too
    small lets more windows through and loses none. Texts are known by content, so copies are marked together.
    """
    added = ("n_words", "n_removed", "kept")
    docs = docs.drop(*added)
    spark, body = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    bytes_ = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    bits = sketch.bits_for(bytes_ / 80, 14, max_bits)
    sketches = spark.sparkContext.broadcast(sketch.repeated(docs.select(text), _anchor_keys(text, width, gram), bits))
    one, two, from_, over = W.free_names(docs.columns, "_t1", "_t2", "_starts", "_spans")
    keyed = docs.select("*", F.xxhash64(body).alias(one), F.xxhash64(F.lit(1), body).alias(two))
    rows = keyed.select(text, F.col(one).alias("t1"), F.col(two).alias("t2")).mapInArrow(_suspects(text, width, gram, bits, sketches), _ROWS)
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_confirm, _FOUND)
    marks = found.groupBy(F.col("t1").alias(one), F.col("t2").alias(two)).agg(F.collect_list("starts").alias(from_), F.collect_list("spans").alias(over))
    names = docs.columns
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("n_words long, n_removed long, kept string").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, spans = batch.column(from_), batch.column(over)
            counts, gone, kept = [], [], []
            for a, b, buf, off in W.text_slices(batch.column(text)):
                w = W.find_words(buf, off, W.SPACE)
                raw = buf.tobytes()
                for i in range(b - a):
                    f, e = int(w.first[i]), int(w.first[i + 1])
                    edge = np.zeros(e - f + width + 1, np.int64)
                    for s in starts[a + i].as_py() or ():
                        at = np.frombuffer(s, np.int32)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + width, -1)
                    for s in spans[a + i].as_py() or ():
                        for x, y in np.frombuffer(s, np.int32).reshape(-1, 2):
                            edge[x] += 1
                            edge[y] -= 1
                    keep = np.flatnonzero(np.cumsum(edge[: e - f]) == 0) + f
                    counts.append(e - f)
                    gone.append(e - f - len(keep))
                    kept.append(b" ".join(raw[x:y] for x, y in zip(w.start[keep].tolist(), w.end[keep].tolist())).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=[*names, *added])

    return keyed.join(marks, [one, two], "left").mapInArrow(cut, schema)
