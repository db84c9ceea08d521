"""Story fields from a spec to the plan, the large-blur gate, and boxes from a read-back."""

import json

from pyspark.sql import functions as F

from spoolwise.operators import pii
from spoolwise.plans import build, validate
from spoolwise.sources import records as rc


def test_story_fields_reach_the_plan(spark):
    specs = [
        {"start": 10, "end": "0:00:40", "title": "One", "lines": "only", "qr": "https://a.example/x", "cards": [{"title": "C", "lines": "l"}, {"title": "D", "image": "d.png"}],
         "overlays": [{"start": 12, "end": "0:00:14", "text": "seen"}, {"start": 500, "end": 501, "text": "never", "position": "bottom"}], "layout": {"screen": [0, 0, 9, 9]}},
        {"start": 50, "end": 60, "title": "Two", "layout": "full"},
    ]
    good, bad = rc.parse_moment_specs(spark.createDataFrame([(1, json.dumps(specs))], "recording_id long, text string"))
    assert bad.count() == 0
    m = good.withColumnRenamed("req_ix", "moment_ix").withColumns({
        "takeaway": F.col("title"), "why": F.lit(""), "lesson": F.lit(""), "context": F.lit(""), "segments": F.lit(None).cast("array<struct<a:double,b:double>>")})
    recs = spark.createDataFrame([(1, "a.mp4", 90.0, "T", "2024-01-01")], "recording_id long, path string, duration_seconds double, title string, date string")
    plans = build.plan_documents(build.build_reel_plan(m, recs))
    one, two = json.loads(plans.first().plan_json)["clips"]
    assert one["card"]["qr"] == "https://a.example/x" and one["card"]["seconds"] == 4.0 and one["card"]["lines"] == ["only"]
    assert one["cards"] == [{"title": "C", "lines": ["l"], "seconds": 3.0}, {"title": "D", "lines": [], "seconds": 4.0, "image": "d.png"}]
    assert one["overlays"] == [{"start": 12.0, "end": 14.0, "text": "seen", "position": "top"}]
    assert one["layout"] == {"kind": "pip", "screen": [0, 0, 9, 9], "corner": "bottom-right"} and not {"layout", "cards", "overlays"} & set(two)
    assert validate.violations(plans.withColumnRenamed("recording_id", "plan_id")).count() == 0


BOXES = "recording_id long, start double, end double, x int, y int, w int, h int, why string"


def test_large_blurs_are_refused_by_hand_only(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0, 0, 0, 1900, 1000, "manual"), (2, 0.0, 5.0, 0, 0, 50, 50, "manual")], BOXES)
    for by_hand, allow, left in ((False, False, {1, 2}), (True, False, {2}), (True, True, {1, 2})):
        kept, notes = pii.gate_large_blurs(df, 1920, 1080, by_hand=by_hand, allow=allow)
        assert {r.recording_id for r in kept.collect()} == left
        assert [(r.recording_id, r.refused) for r in notes.collect()] == [(1, by_hand and not allow)]


def test_read_back_hits_become_boxes(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0, 100, 100, 50, 20, "email")], BOXES)
    hits = spark.createDataFrame([(1, 4.0, "email", (110, 102, 40, 16)), (1, 50.0, "key", (0, 0, 10, 10))], "recording_id long, frame_ts double, kind string, box struct<x:int,y:int,w:int,h:int>")
    got = [tuple(r) for r in pii.add_read_back(df, hits, 1920, 1080).orderBy("start").collect()]
    assert [g[1:3] for g in got] == [(0.0, 6.0), (48.0, 52.0)] and got[0][7] == "email, email (read back)" and got[1][3:7] == (0, 0, 20, 20)


def test_card_lines_are_worked_out_once(spark):
    """A card's lines are bound by name: the expression doesn't grow with each use of them, nor the work with their words."""
    from spoolwise.functions import text as tx
    from spoolwise.plans import cards

    df = spark.createDataFrame([(["alpha beta gamma", "beta gamma delta", " ", "gamma one", "two", "three"],)], "x array<string>")
    size = lambda c: df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().count("regexp_replace(")
    one = size(tx.clip_text(F.col("x")[0], 120))
    assert size(cards.opening_card(F.col("x"), F.lit("T"))) <= 2 * one and size(cards.closing_cards(F.col("x"))) <= one
    got = df.select(cards.opening_card(F.col("x"), F.lit("T")).alias("o"), cards.closing_cards(F.col("x")).alias("c")).first()
    assert got.o.lines == ["5 moments on gamma, beta", "alpha beta gamma", "beta gamma delta", "gamma one"] and got.o.seconds == 7.5
    assert [(c.title, c.lines) for c in got.c] == [("Takeaways", ["alpha beta gamma", "beta gamma delta", "gamma one", "two"]), ("Takeaways (continued)", ["three"])]


def test_cues_are_scored_once_for_both_ends_of_a_window(spark):
    from spoolwise.operators import picks

    cues = spark.createDataFrame([(1, n, 10.0 * n, 10.0 * n + 9, "talk of alpha") for n in range(8)], "recording_id long, cue_ix int, start double, end double, text string")
    found = picks.window_candidates(cues, "alpha", 15, 60)
    assert found.inputFiles() and found.count() > 0
