"""Importance resampling towards a target: hashed n-gram features, bucket gains, Gumbel top-k."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.scans import cut_lineage
from . import words as W
from .words import free_names

PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BUCKETS = 10_000
_SHORT = 64
"""Lengths in bytes below which a checksum moves on by one table; longer ones take a table for each bit of the length."""


def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of one byte; the map of a checksum over n zero bytes for n below ``_SHORT``; the same for powers of two.

    The map is linear over bits, so it is the xor of four table values, one for each byte of the checksum.
    """
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    short = [now]
    for _ in range(_SHORT):
        now = one[now & 255] ^ (now >> np.uint32(8))
        short.append(now)
    doubled = [short[1]]
    for _ in range(40):
        doubled.append(_moved(doubled[-1], doubled[-1]))
    return one, np.stack(short[:_SHORT]), np.stack(doubled)


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & 255]
    for k in range(1, 4):
        out = out ^ table[k][(crc >> np.uint32(8 * k)) & 255]
    return out


_ONE, _SHIFT, _DOUBLED = _crc_tables()


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``crc`` moved on over ``size`` bytes: the checksum of a + b is that of a, moved on over b, xor that of b."""
    n = np.minimum(size, _SHORT - 1)
    out = _SHIFT[n, 0, crc & 255]
    for k in range(1, 4):
        out = out ^ _SHIFT[n, k, (crc >> np.uint32(8 * k)) & 255]
    for at in np.flatnonzero(size >= _SHORT).tolist():
        c = crc[at : at + 1]
        for bit in range(int(size[at]).bit_length()):
            if int(size[at]) >> bit & 1:
                c = _moved(_DOUBLED[bit], c)
        out[at] = c[0]
    return out


def span_crcs(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    ordered, begin = -size[order], start[order]
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(ordered, -_SHORT, "right"))
    for at in range(min(_SHORT - 1, int(-ordered[long]) if long < len(order) else 0)):
        live = slice(long, int(np.searchsorted(ordered, -at, "left")))
        now = crc[live]
        crc[live] = _ONE[(now ^ buf[begin[live] + at]) & 255] ^ (now >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for n in range(long):
        crc[n] = zlib.crc32(buf[begin[n] : begin[n] - int(ordered[n])])
    out = np.empty_like(crc)
    out[order] = crc
    return out


class Features:
    """Buckets of all runs of 1 to ``most`` consecutive words of a text."""

    def __init__(self, pattern: str, most: int, buckets: int):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.most, self.buckets = most, buckets

    def slice(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Words of each row, the bucket numbers of its features one row after the other, and where each row's begin."""
        low = W.LOWER[buf]
        raw = low.tobytes()
        found = [self.split.pre_tokenize_str(raw[a:b].decode()) if b > a else [] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        n = int(counts.sum())
        pairs = np.fromiter(chain.from_iterable(o for x in found for _, o in x), np.int64, 2 * n).reshape(-1, 2)
        del found
        # offsets count characters from a row's start; the bytes at which characters begin give the byte spans
        chars = np.append(np.flatnonzero((low & 0xC0) != 0x80), len(low))
        first = np.searchsorted(chars, offsets[:-1])
        rows = np.repeat(np.arange(len(counts)), counts)
        start, end = chars[pairs[:, 0] + first[rows]], chars[pairs[:, 1] + first[rows]]
        crc, size = span_crcs(low, start, end), end - start
        spaced = shifted(np.full(n, zlib.crc32(b" "), np.uint32), size) ^ crc
        upto = np.concatenate(([0], np.cumsum(counts)))
        left = upto[1:][rows] - np.arange(n)  # words from this one to the row's end
        made, where, run = [crc], [np.arange(n)], crc
        for k in range(1, self.most):
            at = np.flatnonzero(left > k)
            grown = run[at] if k == 1 else run[np.searchsorted(where[-1], at)]
            run = shifted(grown, size[at + k] + 1) ^ spaced[at + k]
            made.append(run)
            where.append(at)
        sizes = sum(np.maximum(counts - k, 0) for k in range(self.most))
        edge = np.concatenate(([0], np.cumsum(sizes)))
        out, at = np.empty(int(edge[-1]), np.uint16 if self.buckets <= 1 << 16 else np.uint32), edge[:-1].copy()
        for k, (c, w) in enumerate(zip(made, where)):
            own = np.maximum(counts - k, 0)
            before = np.concatenate(([0], np.cumsum(own)))[:-1]
            out[np.repeat(at - before, own) + np.arange(len(c))] = c % np.uint32(self.buckets)
            at += own
        return counts, out, edge


def bucket_features(docs: DataFrame, key: str, text: str, most: int = 3, buckets: int = BUCKETS, pattern: str = PATTERN) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``buckets`` (packed bucket numbers, little-endian) of each whole text.

    Words are the matches of ``pattern`` in the text with A-Z lowered, found by an untrained pre-tokeniser with their
    offsets. A feature is a run of 1 to ``most`` consecutive words joined by one space; its bucket is the CRC-32 of its
    UTF-8 bytes modulo ``buckets``. Null and empty texts have none. One pass, no shuffle.
    """
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(pattern, most, buckets)
        for batch in batches:
            for a, b, buf, off in W.text_slices(batch.column("text")):
                counts, out, edge = made.slice(buf, off)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer((edge * out.itemsize).tobytes()), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(a, b - a), pa.array(counts), pa.array(np.diff(edge)), packed.cast(pa.binary())],
                    names=["key", "n_words", "n_features", "buckets"])

    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {kind}, n_words long, n_features long, buckets binary")


def _numbers(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a batch, and where each row's begin."""
    kind = np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    packed = batch.column("buckets").cast(pa.large_binary())
    _, off, data = packed.buffers()
    edge = np.frombuffer(off, np.int64)[packed.offset : packed.offset + len(packed) + 1]
    flat = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None and len(edge) else np.zeros(0, np.uint8)
    return flat.view(kind), (edge - edge[0]) // kind.itemsize


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds: counted in each task, summed by Spark; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    width, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + width)) / float((s + 1) * (t_all + width))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``features`` without ``buckets`` but with ``weight``, the sum of the gains of a text's features."""
    kinds = [f for f in features.schema.fields if f.name != "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, edge = _numbers(batch, len(gain))
            upto = np.concatenate(([0], np.cumsum(gain[flat])))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kinds], pa.array(upto[edge[1:]] - upto[edge[:-1]])], names=[*[f.name for f in kinds], "weight"])

    return features.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", weight long")


def gumbel(key: Column, seed: int = 42) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 32 bits of the SHA-256 of seed and key."""
    digest = F.sha2(F.encode(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))), "utf-8"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def number_in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` plus ``name``: 1, 2, 3... in ``order``, worked out part by part.

    Rows are dealt into ranges of the order (equal ones by a number of their own, so they may lie in several ranges) and
    written; a row's number is its place in its range plus the rows in the ranges before it. There is one sum for each
    range, as many as Spark has shuffle partitions.
    """
    tie, part, place, before = free_names(df.columns, "_tie", "_part", "_place", "_before")
    own = cut_lineage(df.withColumn(tie, F.monotonically_increasing_id()))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(own.repartitionByRange(n, *order, F.col(tie).asc()).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(before))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, F.coalesce(F.sum(before).over(ahead), F.lit(0)).alias(before))
    inside = dealt.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order, F.col(tie).asc())))
    return inside.join(starts, part).select(*df.columns, (F.col(before) + F.col(place)).cast("long").alias(name))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5,
    least_words: int = 20, most: int = 3, buckets: int = BUCKETS, seed: int = 42,
) -> DataFrame:
    """``key``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``.

    Draws floor(``percent`` of the rows with ``least_words`` words or more / 100) rows without replacement, with chances
    in proportion to exp(weight / 1000): the highest scores (weight plus Gumbel noise by key), ties to the smaller key,
    then fewer features, then the smaller weight. ``rank`` counts the drawn rows from 1 and is null for all others. A
    null key counts as the empty string and comes first among ties; rows that repeat all of this follow each other in
    any order. Null and empty texts have no words. An empty ``target`` leaves gains by rarity in ``docs`` alone; empty
    ``docs`` give no rows. Other columns are not looked at.

    Texts are split once; their bucket numbers, two bytes a feature, are written to the shared folder and read twice.
    """
    features = cut_lineage(bucket_features(docs, key, text, most, buckets))
    goal = bucket_features(target.withColumn("_none", F.lit(None).cast("int")), "_none", target_text, most, buckets)
    gain = gains(histogram(features, buckets), histogram(goal, buckets))
    scored = weights(features, gain).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed))
    scored = cut_lineage(scored)
    enough = F.col("n_words") >= least_words
    draw = percent * scored.where(enough).count() // 100
    order = [F.col("score").desc(), F.col("key").asc(), F.col("n_features").asc(), F.col("weight").asc()]
    ranked = number_in_order(scored.where(enough), order, "rank").withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    out = ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.withColumnRenamed("key", key)
