import random

import pytest
from pyspark.sql import Window, functions as F

from spoolwise.operators import cuts, folds, intervals as iv, picks as pk, scans as sc, transcript as tr


def test_chunked_scan_equals_one_window(spark):
    rnd = random.Random(7)
    rows = [(1 if rnd.random() < 0.7 else 2, n, rnd.randint(0, 9) if rnd.random() < 0.6 else None) for n in range(400)]
    df = spark.createDataFrame(rows, "recording_id long, ix long, v int")
    got = sc.scan(
        df, ["recording_id"], ["ix"], sc.by_index("ix", 7), t=sc.total(F.coalesce("v", F.lit(0))), b=sc.before(F.col("v")), u=sc.upto(F.col("v")),
        a=sc.after(F.col("v")), o=sc.onward(F.col("v")), p=sc.peak_before(F.col("v")), l=sc.low_after(F.col("v")),
    )
    w = Window.partitionBy("recording_id").orderBy("ix")
    past, future = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select(
        "*", F.sum(F.coalesce("v", F.lit(0))).over(w).alias("t"), F.last("v", True).over(past).alias("b"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("u"), F.first("v", True).over(future).alias("a"),
        F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("o"), F.max("v").over(past).alias("p"), F.min("v").over(future).alias("l"),
    )
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_neighbours_across_chunks(spark):
    df = spark.range(50).select(F.lit(1).cast("long").alias("recording_id"), F.col("id").alias("ix"), (F.col("id") * 2).alias("v"))
    got = sc.with_neighbours(df, "ix", prev=("v",), next=("v",), rows=4).orderBy("ix").collect()
    assert [(r._prev.v if r._prev else None, r._next.v if r._next else None) for r in got] == [
        (n * 2 - 2 if n else None, n * 2 + 2 if n < 49 else None) for n in range(50)]


def test_interval_algebra(spark):
    rnd = random.Random(3)
    rows = [(k, a := rnd.uniform(0, 500), a + rnd.uniform(0, 30)) for k in (1, 2) for _ in range(60)]
    df = spark.createDataFrame(rows, "recording_id long, start double, end double")
    want = []
    for k in (1, 2):
        out = []
        for a, b in sorted((a, b) for r, a, b in rows if r == k):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        want += [(k, a, b) for a, b in out]
    got = sorted(map(tuple, iv.merge_intervals(df, chunk_seconds=40.0).collect()))
    assert got == sorted(want)
    spans = spark.createDataFrame([(1, 0.0, 600.0), (2, 100.0, 300.0)], "recording_id long, start double, end double")
    rest = iv.complement(spans, df, chunk_seconds=40.0)
    kept = {r.recording_id: r.s for r in rest.groupBy("recording_id").agg(F.sum(F.col("end") - F.col("start")).alias("s")).collect()}
    cut = {r.recording_id: r.seconds for r in iv.overlap_seconds(spans, iv.merge_intervals(df)).collect()}
    assert kept[1] + cut[1] == pytest.approx(600.0) and kept[2] + cut[2] == pytest.approx(200.0)


def test_greedy_pick_goes_round_until_done(spark):
    rnd = random.Random(5)
    rows = [(1 if n % 3 else 2, n, rnd.uniform(0, 300), rnd.randint(0, 50)) for n in range(300)]
    df = spark.createDataFrame([(k, n, s, s + 12, sc_) for k, n, s, sc_ in rows], "recording_id long, i long, start double, end double, score int")
    got = folds.greedy_pick(df, [-F.col("score"), F.col("i")], 6, lambda p, x: (x["start"] < p["end"]) & (x["end"] > p["start"]), pool=4)
    want = set()
    for k in (1, 2):
        taken = []
        for _, n, s, e, _ in sorted([(r[0], r[1], r[2], r[2] + 12, r[3]) for r in rows if r[0] == k], key=lambda r: (-r[4], r[1])):
            if len(taken) < 6 and not any(s < b and e > a for _, a, b in taken):
                taken.append((n, s, e))
        want |= {(k, n) for n, _, _ in taken}
    assert {(r.recording_id, r.i) for r in got.collect()} == want


def cues_of(spark, rows):
    return spark.createDataFrame([(1, n, *r) for n, r in enumerate(rows)], "recording_id long, cue_ix int, start double, end double, text string, speaker string")


def test_window_rules(spark):
    rows = [(n * 4.0, n * 4.0 + 4, "agents agents write" if n in (3, 4, 5, 6) else "other words here", "A") for n in range(20)]
    got = pk.best_windows(cues_of(spark, rows), "agents", 12, 30, 1).first()
    assert (got.i, got.j) == (3, 6)


def test_sentences(spark):
    rows = [(0.0, 4.0, "Hello there. This is", "A"), (4.0, 8.0, "one thing. And", "A"), (8.0, 12.0, "Yes.", "B"), (12.0, 16.0, "no end", "B")]
    got = [(r.start, r.text, r.speaker) for r in tr.sentences(cues_of(spark, rows)).orderBy("sent_ix").collect()]
    assert got == [(0.0, "Hello there.", "A"), (0.0, "This is one thing.", "A"), (4.0, "And.", "A"), (8.0, "Yes.", "B"), (12.0, "no end.", "B")]


def words_of(spark, rows):
    return spark.createDataFrame(
        [(1, n, a, b, t, None, True, None, None) for n, (a, b, t) in enumerate(rows)],
        "recording_id long, word_ix long, start double, end double, text string, speaker string, timed boolean, cut_start double, cut_end double",
    )


def test_filler_mask(spark):
    rows = [(0, 1, "I"), (1, 2, "like"), (2, 3, "this,"), (3, 4, "um"), (5, 6, "like,"), (6.5, 7, "you"), (7, 8, "know,"), (8, 9, "you"), (9, 10, "know"), (10, 11, "it")]
    got = [r.filler for r in cuts.filler_mask(words_of(spark, [(float(a), float(b), t) for a, b, t in rows])).orderBy("word_ix").collect()]
    assert got == [False, False, False, True, True, True, True, False, False, False]


def test_tighten(spark):
    rows = [(1.0, 1.5, "So"), (1.5, 2.5, "today"), (5.0, 5.5, "we"), (5.5, 7.0, "build."), (7.5, 7.8, "Um,"), (8.2, 10.0, "done.")]
    w = words_of(spark, rows)
    m = spark.createDataFrame([(1, 0, 1.0, 10.0)], "recording_id long, req_ix int, start double, end double")
    plain = cuts.cut_moments(m, w, None).first()
    assert [(round(s.a, 3), round(s.b, 3)) for s in plain.segments][0] == (0.85, 2.675) and plain.fillers == 1
    sil = spark.createDataFrame([(1, 2.6, 4.9), (1, 7.1, 7.45), (1, 7.85, 8.15)], "recording_id long, start double, end double")
    heard = cuts.cut_moments(m, w, sil).first()
    assert heard.fillers == 1 and heard.embedded == 0 and not heard.intact and heard.silence_seconds > 1.5
    kept = sum(s.b - s.a for s in heard.segments)
    assert kept + heard.filler_seconds + heard.silence_seconds == pytest.approx(heard.pad_end - heard.pad_start)
    none = cuts.cut_moments(m, w, sil.where("false")).first()
    assert len(none.segments) == 1 and none.embedded == 1


def test_snap_to_words(spark):
    rows = [(0.0, 0.5, "One."), (1.5, 2.0, "Two"), (2.0, 2.5, "three"), (2.5, 3.0, "four."), (4.0, 4.5, "Five.")]
    a = cuts.annotate_words(words_of(spark, rows))
    r = spark.createDataFrame([(1, 0, 2.2, 2.2), (1, 1, 1.0, 3.5), (1, 2, 0.2, 0.5)], "recording_id long, req_ix int, start double, end double")
    got = [(x.snap_start, x.snap_end) for x in cuts.snap_to_words(r, a).orderBy("req_ix").collect()]
    assert got == [(1.5, 3.0), (1.5, 3.0), (0.0, 0.5)]


def test_finish_thought(spark):
    rows = [(0.0, 1.0, "And"), (1.0, 1.5, "the"), (1.5, 2.0, "trick"), (2.0, 2.5, "is."), (3.0, 4.0, "Write"), (4.0, 5.0, "tests."), (9.0, 9.5, "Bye.")]
    a = cuts.annotate_words(words_of(spark, rows))
    e = spark.createDataFrame([(1, 0, 2.5), (1, 1, 5.0)], "recording_id long, req_ix int, end double")
    assert [r.finished for r in cuts.finish_after_words(e, a).orderBy("req_ix").collect()] == [5.0, 5.0]


def test_align_and_fill(spark):
    rows = [(0.0, 4.0, "the deployment pipeline broke", None), (4.0, 5.0, "Okay.", None), (5.0, 9.0, "deployment pipeline works again", None)]
    u = spark.createDataFrame([(1, 0, 2.0, "Ann", "our deployment pipeline broke"), (1, 1, 6.0, "Ann", "pipeline works again")], "recording_id long, utt_ix int, time double, speaker string, text string")
    got = tr.fill_speakers(tr.align_speakers(cues_of(spark, rows), u)).orderBy("cue_ix").collect()
    assert [r.speaker for r in got] == ["Ann", "Ann", "Ann"]


def test_resolve_and_fit(spark):
    m = spark.createDataFrame([(1, 0, 0.0, 30.0, 5.0), (1, 1, 29.0, 60.0, 9.0), (1, 2, 59.5, 60.4, 1.0), (1, 3, 200.0, 220.0, 2.0)], "recording_id long, moment_ix long, start double, end double, score double")
    kept, notes = pk.resolve_overlaps(m)
    assert sorted((r.moment_ix, r.start, r.end) for r in kept.collect()) == [(0, 0.0, 30.0), (1, 30.0, 60.0), (3, 200.0, 220.0)]
    assert {r.moment_ix for r in notes.collect()} == {1, 2}
    assert {r.moment_ix for r in pk.fit_moments(m, 1.0).collect()} == {1}


def test_context_is_exact_and_travels_by_stretch(spark):
    """Words and silences of a moment over several stretches, none from outside; rows travel to stretches, not to moments."""
    words = [(r, k, k * 1.5 + r, k * 1.5 + r + (400.0 if k == 3 else 1.0), f"w{k}", k % 11 != 5) for r in (1, 2) for k in range(600)]
    sil = [(r, k * 7.0, k * 7.0 + 2.0) for r in (1, 2) for k in range(130)]
    moments = [(r, n, s, s + d) for r in (1, 2) for n, (s, d) in enumerate([(0.0, 5.0), (100.0, 30.0), (119.9, 0.2), (121.0, 500.0), (890.0, 100.0), (5000.0, 3.0)])]
    moments += [(1, n, 200.0 + n % 40, 230.0 + n % 40) for n in range(6, 80)] + [(None, 0, 1.0, 2.0), (3, 0, 1.0, 2.0), (1, 999, None, 4.0)]
    m = spark.createDataFrame(moments, f"{sc.KEY} long, req_ix long, start double, end double")
    w = spark.createDataFrame(words, f"{sc.KEY} long, word_ix long, start double, end double, text string, timed boolean")
    q = spark.createDataFrame(sil, f"{sc.KEY} long, start double, end double")
    x = cuts.with_context(m, w, q)
    got = {(r[sc.KEY], r.req_ix): ([v.text for v in r.words], [v.a for v in r.silences]) for r in x.collect()}
    want = {}
    for r, n, s, e in moments:
        met = lambda rows, a, b: [v for v in rows if s is not None and v[0] == r and v[a] <= e + 3 and v[b] >= s - 3]  # noqa: E731, B023
        want[r, n] = [v[4] for v in met([v for v in words if v[5]], 2, 3)], [v[1] for v in met(sil, 1, 2)]
    assert got == want
    dealt = cuts.at_homes(cuts.homes(m, F.col("start") - 3, F.col("end") + 3, 120.0)[1], q, ("start", "end"), 120.0)
    assert dealt.count() < 3 * len(sil)


def test_moment_texts_by_stretch(spark, monkeypatch):
    """Cues are written once for each stretch of time, not for each moment, and say the same as the cues of each moment."""
    rnd = random.Random(5)
    said = ["We decided this.", "Then it", "works, and that is the lesson of", "the whole day.", "Why?", "Because the build is green now."]
    cues = [(r, k, k * 3.0, k * 3.0 + 3.0, rnd.choice(said), rnd.choice(["ann", "bob", None])) for r in (1, 2) for k in range(90)]
    moments = [(r, n, s, s + rnd.choice([4.0, 30.0, 200.0])) for r in (1, 2) for n, s in enumerate(rnd.uniform(0, 270) for _ in range(60))]
    moments += [(None, 0, 1.0, 9.0), (3, 0, 1.0, 9.0), (1, 60, None, 9.0), (2, 60, 9000.0, 9010.0)]
    c = spark.createDataFrame(cues, f"{sc.KEY} long, cue_ix int, start double, end double, text string, speaker string")
    m = spark.createDataFrame(moments, f"{sc.KEY} long, moment_ix long, start double, end double")
    spans = m.select(sc.KEY, "moment_ix", F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    want = pk.moment_texts(m, c, inside=iv.cues_in_moment(spans, c))
    written, inner = [], pk.cut_lineage
    monkeypatch.setattr(pk, "cut_lineage", lambda df: (lambda out: (written.append(out.count()), out)[1])(inner(df)))
    got = pk.moment_texts(m, c)
    assert got.columns == want.columns
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert sum(written) < 4 * len(cues)
