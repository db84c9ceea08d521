"""Quality rules: statistics of each text, an isolation forest over them, and a threshold from labelled rows."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from . import words as W

# The base rules.
SYMBOLS = "#*$%&|<>"
REPEAT_WIDTH, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30

FIT_ROWS = 20_000
"""Labelled documents that the trees are fitted on, in order of a hash of their key; the threshold counts all."""
BINS = 1 << 20
"""Steps of the score that the threshold tells apart, and so the bound on what reaches the driver for it."""
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("0"):ord("9") + 1] = _LETTER[ord("a"):ord("z") + 1] = _LETTER[ord("A"):ord("Z") + 1] = True
_LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a"):ord("z") + 1] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_echoes", "n_upper", "n_lower", "n_plain_words", "n_marks"]
FEATURES = ["chars a word", "symbols a word", "marks a word", "share of words like the one before", "share of capitals", "share of words without letters"]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return np.diff(total[offsets])


def count_slice(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``COUNTS`` and ``MORE`` of each row of a slice."""
    w = W.find_words(buf, offsets, W.SPACE)
    n_words = w.counts
    inside = ~W.SPACE[buf]
    chars = _per_row(inside & ((buf & 0xC0) != 0x80), offsets)
    letters = np.concatenate(([0], np.cumsum(_LETTER[buf], dtype=np.int64)))
    plain = letters[w.end] == letters[w.start]
    repeat, echo = np.zeros(len(w.start), bool), np.zeros(len(w.start), bool)
    own = w.hashes()
    echo[1:] = own[1:] == own[:-1]
    echo[w.first[:-1][w.first[:-1] < len(echo)]] = False
    hashes, ok = W.windows(own, w.first, REPEAT_WIDTH)
    at = np.flatnonzero(ok)
    if len(at):
        key = W.mix(hashes[at] ^ W.mix(w.rows()[at].astype(np.uint64), 11), 12)
        order = np.sort(key)
        again = np.unique(order[1:][order[1:] == order[:-1]])
        if len(again):
            near = np.minimum(np.searchsorted(again, key), len(again) - 1)
            repeat = W.cover(at[again[near] == key], len(w.start), REPEAT_WIDTH)
    dup = []
    raw = buf.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
        dup.append(len(lines) - len(set(lines)))
    marks = inside & ~_LETTER[buf]
    return np.stack([
        n_words, chars, _per_row(_IS_SYMBOL[buf], offsets), np.array(dup, np.int64), _per_row(repeat, w.first), _per_row(echo, w.first),
        _per_row(_UPPER[buf], offsets), _per_row(_LOWER[buf], offsets), _per_row(plain, w.first), _per_row(marks, offsets)], 1)


def features(counts: np.ndarray) -> np.ndarray:
    """Shares that do not grow with the text, as ``FEATURES``; repeats are left to the base rules."""
    words, chars, symbols, _, _, echoes, upper, lower, plain, marks = counts.T.astype(np.float64)
    n = np.maximum(words, 1)
    return np.stack([chars / n, symbols / n, marks / n, echoes / n, upper / np.maximum(upper + lower, 1), plain / n], 1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search among n points."""
    n = np.asarray(n, np.float64)
    big = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees of random splits, as flat arrays; a point that few splits isolate is an anomaly."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    path: np.ndarray
    sample: int

    @staticmethod
    def fit(points: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 7) -> IsolationForest:
        rng = np.random.default_rng(seed)
        sample = min(sample, len(points))
        depth = max(1, int(np.ceil(np.log2(max(2, sample)))))
        size = 2 ** (depth + 1) - 1
        feature, split = np.full((trees, size), -1, np.int16), np.zeros((trees, size))
        child, path = np.zeros((trees, size), np.int32), np.zeros((trees, size))
        for t in range(trees):
            todo, used = [(0, rng.choice(len(points), sample, replace=False), 0)], 1
            while todo:
                node, own, level = todo.pop()
                x = points[own]
                low, high = x.min(0), x.max(0)
                open_ = np.flatnonzero(high > low)
                if level == depth or len(own) < 2 or not len(open_):
                    path[t, node] = level + _mean_path(len(own))
                    continue
                f = int(rng.choice(open_))
                cut = rng.uniform(low[f], high[f])
                left = x[:, f] < cut
                feature[t, node], split[t, node], child[t, node] = f, cut, used
                todo += [(used, own[left], level + 1), (used + 1, own[~left], level + 1)]
                used += 2
        return IsolationForest(feature, split, child, path, sample)

    def score(self, points: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies, below a half for the crowd."""
        total, rows = np.zeros(len(points)), np.arange(len(points))
        for t in range(len(self.feature)):
            at = np.zeros(len(points), np.int64)
            while True:
                f = self.feature[t, at]
                go = f >= 0
                if not go.any():
                    break
                right = points[rows, np.maximum(f, 0)] >= self.split[t, at]
                at = np.where(go, self.child[t, at] + right, at)
            total += self.path[t, at]
        return 2.0 ** (-total / len(self.feature) / max(float(_mean_path(np.array(self.sample))), 1e-9))


@dataclass
class QualityModel:
    forest: IsolationForest | None
    threshold: float

    def score(self, counts: np.ndarray) -> np.ndarray:
        return self.forest.score(features(counts)) if self.forest is not None and len(counts) else np.zeros(len(counts))


_STATS_DDL = ", ".join(f"{c} long" for c in COUNTS + MORE)


def _counted(batch: pa.RecordBatch, text: str) -> np.ndarray:
    parts = [count_slice(buf, off) for _, _, buf, off in W.text_slices(batch.column(text))]
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS + MORE)), np.int64)


def calibrate(score: np.ndarray, good: np.ndarray, good_loss: float, weight: float = 10.0) -> float:
    """The threshold that catches most bad rows for the good ones it loses (one share lost weighs ``weight`` shares
    caught), among those that lose at most a share ``good_loss``; of equal ones the highest, half way to the next score."""
    cuts, at = np.unique(score, return_inverse=True)
    count = [np.bincount(at[rows], minlength=len(cuts)) for rows in (good, ~good)]
    return calibrate_counts(cuts, cuts, *count, good_loss, weight)


def calibrate_counts(low: np.ndarray, high: np.ndarray, good: np.ndarray, bad: np.ndarray, good_loss: float, weight: float = 10.0) -> float:
    """``calibrate`` from numbers of good and bad rows in ascending steps of the score, each with its least and greatest."""
    own, all_bad = np.cumsum(good), np.cumsum(bad)
    if not len(own) or not own[-1]:
        return np.inf
    least = int(np.searchsorted(own, max(1, int(np.ceil((1 - good_loss) * own[-1])))))
    lost = 1 - own[least:] / own[-1]
    caught = 1 - all_bad[least:] / all_bad[-1] if all_bad[-1] else 0.0 * lost
    gain = caught - weight * lost
    best = least + int(np.flatnonzero(gain >= gain.max() - 1e-12)[-1])
    return float(high[best] if best + 1 == len(high) else (high[best] + low[best + 1]) / 2)


def fit_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS,
    good_loss: float = 0.002, bad_share: float = 0.02, trees: int = 200, sample: int = 256, seed: int = 7,
) -> QualityModel:
    """A forest over the statistics of labelled rows that pass the base rules, and its threshold.

    The trees see at most ``fit_rows`` labelled documents, in order of a hash of their key and one row of each: the one
    sample in this operator. Of these they see the good rows and so few bad ones (``bad_share`` of the good) that these
    stay easy to isolate. The threshold is worked out from the scores of all labelled rows, counted in steps of
    ``1 / BINS``, and loses at most ``good_loss`` of those labelled good. Labels that are null or without a document are
    passed over and use up no bound; with fewer than two rows to fit there is no forest, and the base rules decide alone.
    """
    labelled = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("_good"))
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key IS NOT NULL")
    chosen = labelled.join(own.select("_key").distinct(), "_key", "left_semi").orderBy(F.xxhash64("_key"), "_key").limit(fit_rows)
    of_key = own.schema["_key"]

    def passing(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        c = _counted(batch, "_text")
        ok = ~base_failed(c)
        return batch.filter(pa.array(ok)), c[ok]

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, c in map(passing, batches):
            yield pa.RecordBatch.from_arrays([rows.column("_key"), rows.column("_good"), *[pa.array(x) for x in c.T]], ["_key", "_good", *COUNTS, *MORE])

    counted = own.join(F.broadcast(chosen), "_key").mapInArrow(stats, StructType([of_key, *StructType.fromDDL(f"_good int, {_STATS_DDL}").fields]))
    one = counted.groupBy("_key", "_good").agg(F.min(F.struct(*COUNTS, *MORE)).alias("_least"))
    rows = one.select("_good", F.xxhash64("_key").alias("_by"), "_least.*").toPandas().sort_values(["_by", *COUNTS, *MORE], kind="stable")
    if len(rows) < 2:
        warnings.warn("fewer than two labelled documents pass the base rules: no forest, the base rules decide alone", stacklevel=2)
        return QualityModel(None, np.inf)
    points, good = features(rows[COUNTS + MORE].to_numpy(np.int64)), rows["_good"].to_numpy() == 1
    crowd = np.concatenate((points[good], points[~good][: max(1, int(good.sum() * bad_share))])) if good.sum() > 1 else points
    forest = IsolationForest.fit(crowd, trees, sample, seed)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, c in map(passing, batches):
            yield pa.RecordBatch.from_arrays([rows.column("_key"), pa.array(shared.value.score(features(c)))], ["_key", "_score"])

    scored = own.mapInArrow(scores, StructType([of_key, *StructType.fromDDL("_score double").fields]))
    # counted before the join, so that a key on many rows is a few
    steps = scored.groupBy("_key", F.floor(F.col("_score") * BINS).alias("_step")).agg(
        F.count("*").alias("_n"), F.min("_score").alias("_low"), F.max("_score").alias("_high"))
    n = lambda kind: F.sum(F.when(kind, F.col("_n")).otherwise(0))
    found = steps.join(labelled, "_key").groupBy("_step").agg(
        F.min("_low").alias("low"), F.max("_high").alias("high"), n(F.col("_good") == 1).alias("good"), n(F.col("_good") != 1).alias("bad"))
    table = found.toPandas().sort_values("_step")
    return QualityModel(forest, calibrate_counts(*(table[c].to_numpy() for c in ("low", "high", "good", "bad")), good_loss))


def judge(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` plus the statistics (``COUNTS``), ``base_failed``, ``anomaly`` and ``kept``.

    Words are runs of anything but white space; null and empty texts have none and fail the base rules. A row is kept
    if it passes the base rules and its anomaly score is not above the threshold; equal rows fare equally. Columns of
    ``docs`` pass through; those of the added names are replaced. One pass, no shuffle.
    """
    added = [*COUNTS, "base_failed", "anomaly", "kept"]
    docs = docs.drop(*added)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _counted(batch, text)
            failed, score = base_failed(c), shared.value.score(c)
            own = [pa.array(c[:, i]) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], *own, pa.array(failed), pa.array(score), pa.array(~failed & (score <= shared.value.threshold))],
                names=[*names, *added])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(ddl).fields]))
