import json

from pyspark.sql import functions as F

from spoolwise.sources import captions as cp, records as rc


def docs(spark, *texts):
    return spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "recording_id long, text string")


def test_tolerant_srt(spark):
    text = (
        "1\r\n00:00:01,000 --> 00:00:03,5\r\n(Ann Lee)\r\nHello there\r\n-\r\n()\r\n\r\n00:00:04.000 --> 00:00:05.000\nno index\n\n"
        "3\n00:00:06,000 --> 00:00:05,000\nbackwards\n\nnot a cue\n\n4\n00:00:07,000 --> 00:00:08,000\n()\nanon"
    )
    got = [(r.cue_ix, r.start, r.end, r.text, r.speaker) for r in cp.parse_srt(docs(spark, text)).orderBy("cue_ix").collect()]
    assert got == [(0, 1.0, 3.5, "Hello there ()", "Ann Lee"), (1, 4.0, 5.0, "no index", None), (2, 7.0, 8.0, "anon", None)]


def test_strict_srt(spark):
    good = "1\n00:00:01,000 --> 00:00:02,000\nHi\n\nmore of it\n\n2\n00:00:03,000 --> 00:00:04,000\n(Ann)\nyes"
    cues, bad = cp.parse_srt_strict(docs(spark, good, "oops\n\n1\n00:61:00,000 --> 00:62:00,000\nx"))
    assert [(r.cue_ix, r.start, r.text) for r in cues.orderBy("recording_id", "cue_ix").collect()] == [(0, 1.0, "Hi\nmore of it"), (1, 3.0, "(Ann)\nyes")]
    got = [(r.recording_id, r.record_ix, r.message) for r in bad.orderBy("record_ix").collect()]
    assert [g[:2] for g in got] == [(1, 1), (1, 2)] and "60 or more" in got[1][2]


def test_srt_round_trip(spark, tmp_path):
    cues = cp.parse_srt(docs(spark, "1\n00:00:01,000 --> 00:00:02,250\nHi\n\n2\n00:00:03,000 --> 00:00:04,000\nthere"))
    cp.write_srt(cues, str(tmp_path / "out"))
    back = cp.read_srt(spark, str(tmp_path / "out" / "*" / "*.txt"))
    want = [(r.start, r.end, r.text) for r in cues.orderBy("cue_ix").collect()]
    assert [(r.start, r.end, r.text) for r in back.orderBy("cue_ix").collect()] == want


def test_words(spark):
    rows = [{"start": 1, "end": 1.5, "word": " b "}, {"start": 0.5, "end": 0.5, "text": "a"}, {"start": "x", "end": 2, "word": "no"}, {"start": 3, "end": 2, "word": "no"}, 7]
    words, bad = rc.parse_words(docs(spark, json.dumps(rows), "{}"))
    assert [(r.word_ix, r.start, r.end, r.text) for r in words.orderBy("word_ix").collect()] == [(0, 0.5, 0.5, "a"), (1, 1.0, 1.5, "b")]
    assert [r.recording_id for r in bad.collect()] == [1]


def test_notes(spark):
    text = "Summary: ignored\n00:00:10\nAnn: abcd\nnot a line\nBob: efghijkl\n00:00:40\nAnn: " + "x" * 30
    got = [(r.time, r.speaker) for r in rc.parse_notes(docs(spark, text)).orderBy("utt_ix").collect()]
    assert got == [(10.0, "Ann"), (20.0, "Bob"), (40.0, "Ann")]


def test_redactions_and_specs(spark):
    good = [{"start": "0:00:01", "end": 2, "box": [10, 10, 30, 30], "why": "email"}, {"start": 3, "end": 2, "box": [0, 0, 9, 9]}, {"start": 1, "end": 2, "box": [1, 2]}]
    rows, bad = rc.parse_redactions(docs(spark, json.dumps(good)), 100, 100)
    assert [(r.start, r.end, r.x, r.w, r.why) for r in rows.collect()] == [(1.0, 2.0, 10, 30, "email")]
    assert sorted(r.record_ix for r in bad.collect()) == [2, 3]
    specs = [{"start": "1:00", "end": 90, "title": "T", "lines": "one"}, {"start": 5}]
    m, bad = rc.parse_moment_specs(docs(spark, json.dumps(specs)))
    assert [(r.start, r.end, r.title, r.lines) for r in m.collect()] == [(60.0, 90.0, "T", ["one"])]
    assert [r.record_ix for r in bad.collect()] == [2]


def test_media_facts(spark):
    p = json.dumps({"format": {"duration": "12.5"}, "streams": [{"codec_type": "video"}, {"codec_type": "subtitle"}]})
    d = spark.createDataFrame([(1, p), (2, "{}")], "recording_id long, probe_json string")
    ok, bad = rc.media_facts(d)
    r = ok.first()
    assert (r.duration_seconds, r.has_video, r.has_audio, r.subtitle_stream_index) == (12.5, True, False, 0)
    assert [x.recording_id for x in bad.collect()] == [2]


def test_ocr_tsv(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "frame_12.5.tsv").write_text(head + "5\t1\t1\t1\t1\t1\t20\t40\t60\t10\t96.5\tHi\"x\n4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t\n5\t1\t1\t1\t1\t2\tbad\t0\t0\t0\t9\tno\n")
    got = rc.read_ocr_tsv(spark, str(tmp_path), 2.0).collect()
    assert [(r.frame_ts, r.text, r.x, r.y, r.w, r.h, r.conf) for r in got] == [(12.5, 'Hi"x', 10, 20, 30, 5, 96.5)]


def test_manifest_that_repeats_itself(spark):
    """A manifest's fingerprints are met once each, however often it holds them."""
    from pyspark.sql import functions as F

    from spoolwise.sources import records as rc

    rows = spark.range(40).select("id")
    seen = rc.incremental_filter(rows.where("id < 30"), rows.select(F.lit("").alias("fingerprint")), ["id"])
    got = rc.incremental_filter(rows, seen.unionByName(seen).unionByName(seen), ["id"])
    assert sorted(r["id"] for r in got.collect()) == [*range(30, 40)]
    plan = rc.incremental_filter(rows, seen, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2


def test_documents_as_cues(spark):
    """Texts of ids that no other row has are not shuffled; rows that share an id, or have none, come as turns of one recording."""
    from pyspark.sql import functions as F

    from spoolwise.sources import tables as tb

    rows = [(n, " ".join(f"Said {k} of {n}." for k in range(n * 40))) for n in range(5)] + [(7, "Once. Again!"), (None, "No id. None?"), (8, None), (9, "x.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = lambda d: sorted(map(str, tb.cues_from_turns(d.withColumn("_one", F.lit(0)), "doc_id", "_one", "text").collect()))
    got = tb.cues_from_documents(docs)
    assert sorted(map(str, got.collect())) == want(docs) and got.count() > 400
    plan = tb.cues_from_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti, BuildRight" in plan and got.dtypes == tb.cues_from_turns(docs.withColumn("_one", F.lit(0)), "doc_id", "_one", "text").dtypes
    twice = docs.unionByName(docs.where("doc_id = 9"))
    got = tb.cues_from_documents(twice)
    assert sorted(map(str, got.collect())) == want(twice)
    assert got.where("recording_id = 9").select("cue_ix").distinct().count() == 2
