"""Interval algebra over ``(recording_id, start, end)`` tables, chunked by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ranges import overlap_join
from .scans import KEY, after, before, by_time, peak_before, scan, total, upto

CHUNK_SECONDS = 3600.0


def merge_intervals(
    df: DataFrame, gap: float = 0.0, touching: bool = True, keys: Sequence[str] = (KEY,),
    chunk_seconds: float = CHUNK_SECONDS, **carried: Column,
) -> DataFrame:
    """W5 (and U1): the union of intervals. Neighbours up to ``gap`` apart are joined (``touching``: exactly ``gap``
    still joins). ``carried`` adds aggregates over the joined intervals."""
    keys = list(keys)
    chunk = by_time("start", chunk_seconds)
    src = df.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    d = scan(src, keys, ["start", "end"], chunk, _peak=peak_before(F.col("end")))
    apart = F.col("start") - F.col("_peak")
    opens = F.col("_peak").isNull() | ((apart > gap) if touching else (apart >= gap))
    d = scan(d.withColumn("_o", F.when(opens, F.col("start"))), keys, ["start", "end"], chunk, _head=upto(F.col("_o")))
    return d.groupBy(*keys, "_head").agg(
        F.max("end").alias("end"), *[c.alias(n) for n, c in carried.items()]
    ).withColumnRenamed("_head", "start").select(*keys, "start", "end", *carried)


def merge_silences(found: DataFrame, min_seconds: float, blip: float = 0.1, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Silences split by less than ``blip`` of sound are one pause; pauses of at least ``min_seconds`` stay."""
    runs = merge_intervals(found, gap=blip, touching=False, keys=keys)
    return runs.where(F.col("end") - F.col("start") >= min_seconds - 1e-9)


def word_runs(words: DataFrame, gap: float = 0.05, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Stretches of words that follow each other within ``gap``."""
    return merge_intervals(words, gap=gap + 1e-6, keys=keys, words=F.count(F.lit(1)))


def complement(
    spans: DataFrame, removals: DataFrame, keys: Sequence[str] = (KEY,), chunk_seconds: float = CHUNK_SECONDS
) -> DataFrame:
    """W7 (and U2): what is left of each span (one per key) after cutting its removals."""
    keys = list(keys)
    zero = F.lit(0)
    edges = (
        spans.select(*keys, F.col("start").alias("_a"), F.col("start").alias("_b"), zero.alias("_kind"))
        .unionByName(removals.select(*keys, F.col("start").alias("_a"), F.col("end").alias("_b"), (zero + 1).alias("_kind")))
        .unionByName(spans.select(*keys, F.col("end").alias("_a"), F.col("end").alias("_b"), (zero + 2).alias("_kind")))
    )
    # the opening edge comes first and the closing edge last, whatever lies outside the span
    bounds = spans.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    edges = edges.join(bounds, keys).where(
        (F.col("_kind") != 1) | ((F.col("_b") > F.col("_s")) & (F.col("_a") < F.col("_e")))
    ).withColumn("_a", F.greatest("_a", "_s"))
    d = scan(edges, keys, ["_a", "_kind", "_b"], by_time("_a", chunk_seconds), _cur=peak_before(F.col("_b")))
    return d.where((F.col("_kind") > 0) & (F.col("_a") > F.col("_cur"))).select(
        *keys, F.col("_cur").alias("start"), F.col("_a").alias("end")
    )


def intersections(
    a: DataFrame, b: DataFrame, width: float = 60.0, keys: Sequence[str] = (KEY,)
) -> DataFrame:
    """The common part of every pair of an interval of ``a`` and one of ``b``."""
    r = b.select(*keys, F.col("start").alias("_x"), F.col("end").alias("_y"))
    met = overlap_join(
        a, r, ("start", "end"), ("_x", "_y"), width, (F.col("_x") < F.col("end")) & (F.col("_y") > F.col("start")), keys
    )
    return met.withColumns({"start": F.greatest("start", "_x"), "end": F.least("end", "_y")}).drop("_x", "_y")


def overlap_seconds(a: DataFrame, b: DataFrame, width: float = 60.0, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Total length of the intersections, per key."""
    return intersections(a, b, width, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))


def pair_intervals(
    log: DataFrame, offset: float = 0.0, span_end: Column | None = None, tie: str = "event_id",
    chunk_seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """start/end lines of a log become intervals.

    A later start replaces an open one, an end with nothing open is ignored, and an interval still open at the end is
    closed at ``span_end`` (dropped when there is none). ``log``: recording_id, t, kind, and a tie-breaking column.
    """
    d = scan(
        log, [KEY], ["t", tie], by_time("t", chunk_seconds),
        _p=before(F.struct("kind", "t")), _n=after(F.struct("kind")),
    )
    opened = F.greatest(F.lit(offset), offset + F.col("_p.t"))
    closing = F.col("t") + offset
    if span_end is not None:
        closing = F.least(span_end, closing)
    out = d.where((F.col("kind") == "end") & (F.col("_p.kind") == "start")).select(
        KEY, opened.alias("start"), closing.alias("end")
    )
    if span_end is not None:
        left = d.where((F.col("kind") == "start") & F.col("_n").isNull())
        out = out.unionByName(left.select(KEY, F.greatest(F.lit(offset), offset + F.col("t")).alias("start"), span_end.alias("end")))
    return out.where(F.col("end") > F.col("start"))


def sample_times(spans: DataFrame, every: float = 1.0) -> DataFrame:
    """Instants at each span's start, at every step inside it, and just before its end."""
    a, b = F.col("start"), F.col("end")
    steps = F.transform(F.sequence(F.lit(0), F.ceil((b - a) / every) - 1), lambda k: F.round(a + k * every, 2))
    s = spans.where(b > a).select(KEY, F.explode(F.array_append(steps, F.round(F.greatest(a, b - 0.05), 2))).alias("t"))
    return s.distinct()


def cues_in_moment(moments: DataFrame, cues: DataFrame, width: float = 60.0) -> DataFrame:
    """The cues that overlap each moment. ``moments``: recording_id, moment_ix, m_start, m_end."""
    return overlap_join(
        moments, cues, ("m_start", "m_end"), ("start", "end"), width,
        (F.col("end") > F.col("m_start")) & (F.col("start") < F.col("m_end")),
    )


def overlays_on_screen(overlays: DataFrame, segments: DataFrame, width: float = 60.0) -> DataFrame:
    """Overlays that touch a kept segment. ``overlays``: recording_id, overlay_ix, start, end, ...;
    ``segments``: recording_id, s_start, s_end."""
    met = overlap_join(
        overlays.select(KEY, "overlay_ix", "start", "end"), segments.select(KEY, "s_start", "s_end"),
        ("start", "end"), ("s_start", "s_end"), width,
        (F.col("start") < F.col("s_end")) & (F.col("end") > F.col("s_start")),
    )
    return overlays.join(met.select(KEY, "overlay_ix").distinct(), [KEY, "overlay_ix"], "left_semi")


def frames_in_segments(
    frames: DataFrame, segments: DataFrame, video_end: DataFrame | None = None, width: float = 60.0
) -> tuple[DataFrame, DataFrame]:
    """Frames shown by each segment with their output time, and the segments that cannot be shown.

    ``frames``: recording_id, ts; ``segments``: recording_id, seg_ix, s_start, s_end, s_offset;
    ``video_end``: recording_id, v_end.
    """
    shown = overlap_join(
        segments, frames, ("s_start", "s_end"), ("ts", "ts"), width,
        (F.col("ts") >= F.col("s_start")) & (F.col("ts") < F.col("s_end")),
    ).withColumn("out_ts", F.col("ts") - F.col("s_start") + F.col("s_offset"))
    has = shown.select(KEY, "seg_ix").distinct()
    errors = segments.join(has, [KEY, "seg_ix"], "left_anti").withColumn("error", F.lit("contains no video frame"))
    if video_end is not None:
        late = segments.join(video_end, KEY).where(F.col("s_end") > F.col("v_end") + 1e-6)
        errors = errors.unionByName(late.drop("v_end").withColumn("error", F.lit("ends after the video")))
    return shown, errors


def overlay_runs(overlays: DataFrame, shown: DataFrame, width: float = 60.0) -> DataFrame:
    """Per overlay, the stretches of consecutive output frames inside it.

    ``shown``: recording_id, out_ix (position among the kept frames), ts, out_ts.
    """
    o = overlays.select(KEY, "overlay_ix", F.col("start").alias("_a"), F.col("end").alias("_b"))
    hit = overlap_join(o, shown, ("_a", "_b"), ("ts", "ts"), width, (F.col("ts") >= F.col("_a")) & (F.col("ts") < F.col("_b")))
    keys = [KEY, "overlay_ix"]
    chunk = F.floor(F.col("out_ix") / 65536)
    hit = scan(hit.select(*keys, "out_ix", "out_ts"), keys, ["out_ix"], chunk, _rank=total(F.lit(1)))
    return hit.groupBy(*keys, (F.col("out_ix") - F.col("_rank")).alias("_g")).agg(
        F.min("out_ts").alias("first"), F.max("out_ts").alias("last"), F.count(F.lit(1)).alias("frames")
    ).drop("_g")


def elementary(df: DataFrame, keys: Sequence[str] = (KEY,), chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """The stretches between neighbouring edges of all intervals of a key."""
    keys = list(keys)
    edges = df.select(*keys, F.explode(F.array("start", "end")).alias("e_start")).distinct()
    return scan(edges, keys, ["e_start"], by_time("e_start", chunk_seconds), e_end=after(F.col("e_start"))).where(
        F.col("e_end").isNotNull()
    )


def live_boxes(
    redactions: DataFrame, duration: DataFrame | None = None, frame: float = 0.0, width: float = 60.0,
    chunk_seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """The time line cut where the set of blurred boxes changes, each stretch with its boxes.

    Every range is widened by one frame. With ``duration`` (recording_id, duration) the whole recording is covered and
    stretches without boxes are listed too.
    """
    r = redactions.select(KEY, (F.col("start") - frame).alias("start"), (F.col("end") + frame).alias("end"), F.struct("x", "y", "w", "h").alias("box"))
    r = r.withColumn("start", F.greatest("start", F.lit(0.0)))
    marks = r.select(KEY, "start", "end")
    if duration is not None:
        r = r.join(duration, KEY).withColumn("end", F.least("end", "duration")).drop("duration")
        marks = r.select(KEY, "start", "end").unionByName(duration.select(KEY, F.lit(0.0).alias("start"), F.col("duration").alias("end")))
    r = r.where(F.col("end") > F.col("start"))
    parts = elementary(marks.where(F.col("end") > F.col("start")), chunk_seconds=chunk_seconds)
    live = overlap_join(
        parts, r, ("e_start", "e_end"), ("start", "end"), width,
        (F.col("start") < F.col("e_end")) & (F.col("end") > F.col("e_start")),
    ).groupBy(KEY, "e_start", "e_end").agg(F.array_sort(F.collect_set("box")).alias("boxes"))
    if duration is not None:
        none = F.array().cast(live.schema["boxes"].dataType)
        live = parts.join(live, [KEY, "e_start", "e_end"], "left").withColumn("boxes", F.coalesce("boxes", none))
    chunk = by_time("e_start", chunk_seconds)
    d = scan(live, [KEY], ["e_start"], chunk, _p=before(F.struct("e_end", "boxes")))
    opens = F.col("_p").isNull() | (F.col("_p.e_end") != F.col("e_start")) | (F.col("_p.boxes") != F.col("boxes"))
    d = scan(d.withColumn("_o", F.when(opens, F.col("e_start"))).drop("_p"), [KEY], ["e_start"], chunk, _head=upto(F.col("_o")))
    return d.groupBy(KEY, "_head").agg(F.max("e_end").alias("end"), F.first("boxes").alias("boxes")).select(
        KEY, F.col("_head").alias("start"), "end", "boxes"
    )
