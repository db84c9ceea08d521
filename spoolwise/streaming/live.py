"""Blocks and pauses on live captions: the tumbling and gap-based forms of A1 and W6.

The input is a stream with an event-time column ``ts``; state is per key and window, dropped after the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators.scans import KEY


def live_blocks(cues: DataFrame, block: str = "30 seconds", late: str = "2 minutes") -> DataFrame:
    """A1 on a stream of cues: cues and words per recording and block."""
    return cues.withWatermark("ts", late).groupBy(KEY, F.window("ts", block)).agg(
        F.count(F.lit(1)).alias("cues"), F.sum(tx.token_count(F.col("text"))).cast("long").alias("words")
    ).select(KEY, F.col("window.start").alias("block_start"), "cues", "words")


def live_pauses(marks: DataFrame, gap: str = "1 second", late: str = "2 minutes") -> DataFrame:
    """W6 on a stream of quiet moments: runs that follow each other within ``gap``."""
    return marks.withWatermark("ts", late).groupBy(KEY, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("marks")).select(
        KEY, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "marks"
    )
