"""Levels of a sampled signal around cut edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranges import overlap_join
from .scans import KEY

FLOOR_DB = -120.0


def to_db(peak: Column, full_scale: float = 32768.0) -> Column:
    db = 20 * F.log10(peak / full_scale)
    return F.when(peak > 0, F.greatest(F.lit(FLOOR_DB), db)).otherwise(F.lit(FLOOR_DB))


def peak_levels(
    spans: DataFrame, signal: DataFrame, full_scale: float = 32768.0, width: float = 60.0
) -> DataFrame:
    """Peak level of each span (recording_id, span_ix, start, end), the floor where nothing was sampled."""
    hit = overlap_join(spans, signal, ("start", "end"), ("t", "t"), width, (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))
    peak = hit.groupBy(KEY, "span_ix").agg(F.max(F.abs("value")).alias("_p"))
    return spans.join(peak, [KEY, "span_ix"], "left").withColumn("peak_db", to_db(F.coalesce("_p", F.lit(0.0)), full_scale)).drop("_p")


def rms_levels(spans: DataFrame, signal: DataFrame, ix: str, every: int = 4, width: float = 60.0) -> DataFrame:
    """Root mean square of each span over every ``every``-th of its own samples, in order of time, then ``ix``.

    A span is a few hundredths of a second at one edge, so its samples are few and are numbered in one window.
    """
    hit = overlap_join(spans, signal, ("start", "end"), ("t", "t"), width, (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))
    own = Window.partitionBy(KEY, "span_ix").orderBy("t", ix)
    hit = hit.withColumn("_k", F.row_number().over(own) - 1).where(F.col("_k") % every == 0)
    rms = hit.groupBy(KEY, "span_ix").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("_r"))
    return spans.join(rms, [KEY, "span_ix"], "left").withColumn("rms", F.coalesce("_r", F.lit(0.0))).drop("_r")


def segment_edges(segments: DataFrame) -> DataFrame:
    """Both edges of every segment: recording_id, clip, segment, kind, time."""
    edges = F.array(
        F.struct(F.lit("start").alias("kind"), F.col("s_start").alias("time")),
        F.struct(F.lit("end").alias("kind"), F.col("s_end").alias("time")),
    )
    return segments.select(KEY, "clip", "segment", F.explode(edges).alias("e")).select(KEY, "clip", "segment", "e.kind", "e.time")


def audit_edges(
    segments: DataFrame, signal: DataFrame, words: DataFrame | None = None, window: float = 0.04,
    full_scale: float = 32768.0, width: float = 1.0, slack: float = 1e-3,
) -> DataFrame:
    """Peak levels ``window`` seconds before and after each segment edge, and the words that span it."""
    keys = [KEY, "clip", "segment", "kind", "time"]
    edges = segment_edges(segments)
    hit = overlap_join(edges, signal, (F.col("time") - window, F.col("time") + window), ("t", "t"), max(width, 2 * window))
    peak = lambda cond: F.max(F.when(cond, F.abs("value")))
    t, at = F.col("t"), F.col("time")
    levels = hit.groupBy(*keys).agg(
        peak((t >= at - window) & (t < at)).alias("_b"), peak((t >= at) & (t < at + window)).alias("_a")
    )
    out = edges.join(levels, keys, "left").select(
        *keys, to_db(F.coalesce("_b", F.lit(0.0)), full_scale).alias("before_db"),
        to_db(F.coalesce("_a", F.lit(0.0)), full_scale).alias("after_db"),
    )
    none = F.array().cast("array<string>")
    if words is None:
        return out.withColumn("words", none)
    w = words.select(KEY, "word_ix", F.col("start").alias("_ws"), F.col("end").alias("_we"), F.col("text").alias("_w"))
    on = overlap_join(
        edges, w, ("time", "time"), (F.col("_ws") - slack, F.col("_we") + slack), max(width, 1.0),
        F.col("time").between(F.col("_ws") - slack, F.col("_we") + slack),
    ).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("word_ix", "_w")))["_w"].alias("words"))
    return out.join(on, keys, "left").withColumn("words", F.coalesce("words", none))


def offenders(readings: DataFrame, threshold_db: float = -25.0) -> DataFrame:
    """Edges with sound above the threshold on both sides."""
    return readings.where((F.col("before_db") > threshold_db) & (F.col("after_db") > threshold_db))


def audit_report(readings: DataFrame, threshold_db: float = -25.0, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Edges and offenders per recording."""
    both = (F.col("before_db") > threshold_db) & (F.col("after_db") > threshold_db)
    return readings.groupBy(*keys).agg(F.count(F.lit(1)).alias("edges"), F.count_if(both).alias("voiced_both_sides"))


def reconcile_timeline(expected: DataFrame, actual: DataFrame, tolerance: float) -> DataFrame:
    """Frames missing, extra or off by more than ``tolerance``. Both sides: plan_id, ix, ts."""
    e = expected.select("plan_id", "ix", F.col("ts").alias("expected_ts"))
    a = actual.select("plan_id", "ix", F.col("ts").alias("actual_ts"))
    problem = (
        F.when(F.col("actual_ts").isNull(), "missing")
        .when(F.col("expected_ts").isNull(), "extra")
        .when(F.abs(F.col("actual_ts") - F.col("expected_ts")) > tolerance, "moved")
    )
    return e.join(a, ["plan_id", "ix"], "full_outer").withColumn("problem", problem).where(F.col("problem").isNotNull())


def reconcile_duration(expected: DataFrame, actual: DataFrame, per_segment: float | None = None) -> DataFrame:
    """Total lengths that differ by more than the last frame plus 25 ms, or by 0.2 s per segment for a reel.

    ``expected``: plan_id, seconds, tail or segments; ``actual``: plan_id, actual_seconds.
    """
    allowed = F.col("tail") + 0.025 if per_segment is None else per_segment * F.col("segments")
    return expected.join(actual, "plan_id").where(F.abs(F.col("actual_seconds") - F.col("seconds")) > allowed)
