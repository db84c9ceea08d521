"""Timed tables made from plain ones: turns or documents become cues, events become signals and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import offsets as off
from ..functions.let import let
from ..operators.scans import KEY, by_index, cut_lineage, scan, total

CHARS_PER_SECOND = 15.0


def _pieces(text: str) -> Column:
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda p: F.trim(p)), lambda p: p != "")


def cues_from_turns(turns: DataFrame, key: str, order: str, text: str, speaker: str | None = None) -> DataFrame:
    """One cue per sentence of each turn, timed at a constant speaking rate.

    ``order`` numbers the turns of a recording. Turn lengths are summed along the recording first (one row per turn),
    then sentences are numbered inside their turn.
    """
    who = F.col(speaker) if speaker else F.lit(None).cast("string")
    t = turns.select(
        F.col(key).alias(KEY), F.col(order).cast("long").alias("_turn"), who.alias("speaker"), _pieces(text).alias("_p")
    )
    t = t.withColumn("_n", F.size("_p").cast("long"))
    t = t.withColumn("_c", F.aggregate("_p", F.lit(0).cast("long"), lambda a, p: a + F.length(p) + 1))
    t = scan(t, [KEY], ["_turn"], by_index("_turn", 4096), _n_end=total(F.col("_n")), _c_end=total(F.col("_c")))
    rows = t.select(
        KEY, "_turn", "speaker", (F.col("_n_end") - F.col("_n")).alias("_n0"), (F.col("_c_end") - F.col("_c")).alias("_c0"),
        F.posexplode("_p").alias("_pos", "text"),
    )
    inside = Window.partitionBy(KEY, "_turn").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    c = F.col("_c0") + F.sum(F.length("text") + 1).over(inside)
    return rows.select(
        KEY, (F.col("_n0") + F.col("_pos")).cast("int").alias("cue_ix"),
        ((c - F.length("text") - 1) / F.lit(CHARS_PER_SECOND)).alias("start"), (c / F.lit(CHARS_PER_SECOND)).alias("end"),
        "text", "speaker",
    )


def cues_from_documents(docs: DataFrame) -> DataFrame:
    """One recording per document, one cue per sentence, no speakers.

    A document whose id no other row has is timed inside its row, so no text is shuffled. Rows that share an id are
    one recording, which ``cues_from_turns`` puts on one clock.
    """
    shared = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_id")
    shared, same = cut_lineage(shared), F.col("doc_id").eqNullSafe(F.col("_id"))
    together = cues_from_turns(docs.join(shared, same, "left_semi").withColumn("_one", F.lit(0)), "doc_id", "_one", "text")
    alone = docs.join(shared, same, "left_anti").select(F.col("doc_id").alias(KEY), _pieces("text").alias("_p"))
    ends = let(F.transform("_p", lambda p: F.length(p).cast("long") + 1), lambda n: off.running(n, lambda a, b: a + b, "bigint"))
    rows = alone.select(KEY, F.posexplode(F.arrays_zip(F.col("_p").alias("text"), ends.alias("c"))).alias("cue_ix", "_x"))
    c, text = F.col("_x.c"), F.col("_x.text")
    alone = rows.select(
        KEY, "cue_ix", ((c - F.length(text) - 1) / F.lit(CHARS_PER_SECOND)).alias("start"), (c / F.lit(CHARS_PER_SECOND)).alias("end"),
        text.alias("text"), F.lit(None).cast("string").alias("speaker"),
    )
    return alone.unionByName(together)


def epoch(ts: str = "ts") -> Column:
    """Seconds since 1970 of a timestamp; run the session in UTC, as for any stored local time."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def utterances_from_cues(cues: DataFrame, shift: float = 5.0) -> DataFrame:
    """Every cue as a note line, its time shifted: stands in for meeting notes."""
    return cues.select(
        KEY, (F.col("start") + shift).alias("time"), F.col("speaker"), F.col("text"), F.col("cue_ix").alias("utt_ix")
    )


def signal_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias(KEY), (epoch()).alias("t"), F.col("value"), "event_id"
    )


def marks_from_events(events: DataFrame, start: str = "signup", end: str = "error") -> DataFrame:
    """Start and end lines of a log, from two event types."""
    kind = F.when(F.col("event_type") == start, "start").when(F.col("event_type") == end, "end")
    return events.where(F.col("event_type").isin(start, end)).select(
        F.col("user_id").alias(KEY), (epoch()).alias("t"), kind.alias("kind"), "event_id"
    )


def intervals_from_events(events: DataFrame, stretch: float = 1000.0) -> DataFrame:
    t = epoch()
    return events.select(F.col("user_id").alias(KEY), t.alias("start"), (t + F.col("value") * stretch).alias("end"))


def frames_from_embeddings(vectors: DataFrame, per_recording: int = 50) -> DataFrame:
    """Vectors as one-second thumbnails, ``per_recording`` to a recording."""
    return vectors.select(
        F.floor(F.col("vec_id") / per_recording).alias(KEY), (F.col("vec_id") % per_recording).cast("double").alias("ts"),
        F.transform("embedding", lambda x: F.floor(x * 100 + 0.5).cast("int")).alias("thumb"),
    )
