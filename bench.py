"""Headline queries, one JSON line. ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from spoolwise import registry  # noqa: E402
from spoolwise.operators.scans import drop_staged  # noqa: E402

HEADLINE = (
    "p3_score_cue", "p5_teachable", "p15_find_sensitive", "q7_redact_text", "w1_sentences", "w2_sentence_spans", "w5_merge_intervals",
    "j1_align_speakers", "a2_format_blocks", "a9_coverage", "t1_best_window", "t1_best_windows", "j8_neighbours",
    "t3_pick_moments", "t5_fit_moments", "w16_merge_boxes", "w17_screen_runs",
)


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    t0 = time.time()
    for view in ("cues", "long_cues", "words", "timed_words", "annotated", "boxes", "intervals"):
        registry.staged(spark, sf, view)
    times["derive_tables"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        t0 = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    drop_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
