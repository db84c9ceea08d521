
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import boxes as bx, clock as ck, text as tx
from .functions.lexicon import Lexicon
from . import jobs
from .operators import cuts, intervals as iv, picks as pk, pii, signal as sg, transcript as tr
from .operators.scans import KEY, cut_lineage
from .plans import build, cards, validate
from .sources import captions as cp, records as rc, tables as tb

REQUEST = "thing tion erin"
# Words that occur in the generated prose stand in for the phrase lists; the real lists are tested on written fixtures.
PROSE = Lexicon(
    filler=r"\b(?:that|with)\b", decision=r"\b(?:this|from)\b", explain=r"\b(?:which|than)\b", decide=r"\b(?:have|would)\b",
    how_to=r"\b(?:there|their)\b", banter=r"\b(?:about|what)\b",
)
_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def staged(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived table, written once per session to the shared folder, as a pipeline would keep it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGED:
        _STAGED[key] = cut_lineage(_VIEWS[name](spark, sf))
    return _STAGED[key]


def _bare_cues(s, d):
    return staged(s, d, "cues").withColumn("speaker", F.lit(None).cast("string"))


_VIEWS: dict[str, Callable] = {
    "cues": lambda s, d: tb.cues_from_turns(table(s, d, "conversations"), "conv_id", "turn", "text", "role"),
    "long_cues": lambda s, d: tb.cues_from_documents(table(s, d, "documents")),
    "words": lambda s, d: tr.words_from_cues(staged(s, d, "cues")),
    "timed_words": lambda s, d: _timed(staged(s, d, "words")),
    "intervals": lambda s, d: tb.intervals_from_events(table(s, d, "events")),
    "pauses": lambda s, d: iv.pair_intervals(tb.marks_from_events(table(s, d, "events"))),
    "boxes": lambda s, d: _boxes(table(s, d, "events")),
    "recordings": lambda s, d: staged(s, d, "cues").groupBy(KEY).agg(F.max("end").alias("duration_seconds")).select(
        KEY, F.format_string("talk-%d.mp4", KEY).alias("path"), "duration_seconds", F.lit("Session").alias("title"), F.lit("2024-01-01").alias("date")),
    "annotated": lambda s, d: cuts.annotate_words(staged(s, d, "timed_words")),
    "sentence_spans": lambda s, d: tr.sentence_spans(staged(s, d, "words")),
    "reel_plans": lambda s, d: build.plan_documents(build.build_reel_plan(_moments(s, d), staged(s, d, "recordings"))),
    "takeaways": lambda s, d: pk.window_takeaways(staged(s, d, "windows"), staged(s, d, "cues"), REQUEST),
    "windows": lambda s, d: pk.best_windows(staged(s, d, "cues"), REQUEST, 15, 60, 3),
}


def _timed(words: DataFrame) -> DataFrame:
    """Words as if a recogniser had timed them: a little shorter than their slot, so that there are gaps."""
    gap = F.when(F.col("word_ix") % 7 == 0, 0.3).when(F.col("word_ix") % 5 == 0, 0.05).otherwise(0.0)
    none = F.lit(None).cast("double")
    return words.withColumns({
        "end": F.greatest(F.col("start"), F.col("end") - gap), "timed": F.lit(True), "cut_start": none, "cut_end": none,
    })


def _boxes(events: DataFrame) -> DataFrame:
    e, t = F.col("event_id"), tb.epoch()
    return events.select(
        F.col("user_id").alias(KEY), t.alias("start"), (t + F.col("value") * 100).alias("end"),
        (e % 1800).cast("int").alias("x"), (e * 7 % 900).cast("int").alias("y"), (40 + e % 600).cast("int").alias("w"),
        (20 + e % 300).cast("int").alias("h"), F.col("event_type").alias("why"),
    )


def _r(c, n=6):
    return F.round(c, n)


def p1_keywords(s, d):
    q = table(s, d, "benchmark").select("item_id", F.explode(tx.keywords(F.col("text"))).alias("keyword"))
    return q.distinct()


def p2_keyword_hits(s, d):
    kws = tx.keywords(F.lit(REQUEST))
    return staged(s, d, "cues").select(KEY, "cue_ix", tx.keyword_hits(F.col("text"), kws).cast("long").alias("hits"))


def p3_score_cue(s, d):
    kws = tx.keywords(F.lit(REQUEST))
    return staged(s, d, "cues").select(KEY, "cue_ix", _r(tx.score_cue(F.col("text"), tr.seconds(), kws)).alias("score"))


def p4_content_score(s, d):
    return staged(s, d, "cues").select(KEY, "cue_ix", _r(tx.content_score(F.col("text"), tr.seconds(), PROSE)).alias("score"))


def p5_teachable(s, d):
    return staged(s, d, "long_cues").select(KEY, "cue_ix", tx.teachable(F.col("text"), PROSE).alias("points"))


def p6_score_sentence(s, d):
    focus = tx.keywords(F.lit(REQUEST))
    return staged(s, d, "cues").select(KEY, "cue_ix", _r(tx.score_sentence(F.col("text"), focus, PROSE)).alias("score"))


def p7_clean_text(s, d):
    return staged(s, d, "long_cues").select(KEY, "cue_ix", tx.clean_text(F.col("text"), PROSE).alias("clean"))


def p9_clip_text(s, d):
    return staged(s, d, "long_cues").select(KEY, "cue_ix", tx.clip_text(F.col("text"), 40).alias("clipped"))


SETUPS = Lexicon(
    setup_patterns=(r"(?:^| )(?:is|the|in|le|de|der|die|to)(?: [^ ]+){1,3}$",), setup_finished=r" (?:of|a|la|und)(?: |$)",
    setup_rhetorical=r"(?:^| )(?:is|the|le|der|that)(?: .*)?$",
)


def p11_dangling(s, d):
    """Every turn, some left open by a mark, a question or a word that wants another one."""
    bare = F.regexp_replace("text", r"[.!?]+\s*$", "")
    n = (F.col("conv_id") + F.col("turn")) % 5
    said = F.when(n == 0, F.concat(bare, F.lit(":"))).when(n == 1, F.concat(bare, F.lit("?\""))).when(n == 2, F.concat(bare, F.lit(" and."))).otherwise(F.col("text"))
    return table(s, d, "conversations").select("conv_id", "turn", F.coalesce(tx.dangling(said, SETUPS), F.lit("-")).alias("setup"))


def p12_classify(s, d):
    lex = Lexicon(decision_label=r"\bthething\b", demo_label=r"\b(?:this|from)\b")
    return tr.classify(staged(s, d, "cues"), lex=lex).select(KEY, F.coalesce("label", F.lit("none")).alias("label"))


def p14_clamp_box(s, d):
    b = staged(s, d, "boxes").withColumn("box", bx.clamp_box(F.struct("x", "y", "w", "h"), F.lit(1920), F.lit(1080), 6))
    return b.where("box is not null").groupBy(KEY).agg(
        F.count(F.lit(1)).alias("boxes"), F.sum("box.x").alias("x"), F.sum("box.y").alias("y"), F.sum("box.w").alias("w"), F.sum("box.h").alias("h")
    )


def p15_email_key(s, d):
    from .functions.lexicon import SENSITIVE
    kinds = {k: SENSITIVE[k] for k in ("email", "key")}
    hits = pii.find_sensitive(table(s, d, "documents"), ["doc_id"], kinds=kinds)
    return hits.select("doc_id", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "match")


def p15_find_sensitive(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("documents").alias("source"))
    pages = table(s, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.lit("pages").alias("source"))
    return pii.find_sensitive(docs.unionByName(pages), ["source", "id"])


def p16_luhn(s, d):
    """Every run of 13 to 19 digits in the documents, single spaces or hyphens between them allowed."""
    runs = F.regexp_extract_all("text", F.lit(r"[0-9](?:[ -]?[0-9]){12,18}"), F.lit(0))
    found = table(s, d, "documents").select("doc_id", F.explode(runs).alias("digits"))
    return found.groupBy("doc_id", "digits").agg(F.count(F.lit(1)).alias("n")).withColumn("ok", bx.luhn(F.col("digits")))


def p17_term_hits(s, d):
    """Every line of the benchmark texts as a term, and for each text a pattern of its first two words and what follows them."""
    b = table(s, d, "benchmark")
    starts = F.regexp_extract_all("text", F.lit(r"(?U)^\w+ \w+"), F.lit(0))
    free = b.select(F.explode(starts).alias("text")).select(F.concat(F.lit("re:"), F.regexp_replace("text", " ", r"\\s+"), F.lit(r"\w*")).alias("text"))
    terms = b.select(F.explode(F.split("text", "\n")).alias("text")).unionByName(free)
    return pii.term_hits(table(s, d, "documents"), terms, ["doc_id"]).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("hits"))


def p19_clip_to_spans(s, d):
    b = table(s, d, "events").select(F.col("user_id").alias(KEY), (tb.epoch()).alias("start"),
        (tb.epoch() + F.col("value") * 100).alias("end"), F.col("event_id").alias("red_ix"))
    out = pii.clip_to_spans(b, staged(s, d, "pauses"), 60.0, 86400.0)
    return out.select(KEY, "red_ix", _r(F.col("start"), 3).alias("start"), _r(F.col("end"), 3).alias("end"))


def p25_shift_origin(s, d):
    c = tr.shift_origin(staged(s, d, "cues"), 12.5)
    return c.select(KEY, "cue_ix", _r(F.col("start")).alias("start"), _r(F.col("end")).alias("end"))


def f_clocks(s, d):
    c = staged(s, d, "long_cues")
    t = F.col("start")
    return c.select(
        KEY, "cue_ix", ck.clock(t * 9).alias("clock"), ck.ts(t * 9).alias("ts"), ck.srt_time(t).alias("srt"),
        _r(ck.parse_clock(ck.clock(t * 9)), 3).alias("parsed"), ck.frame_count(tr.seconds(), 24).alias("frames"),
    )


def f6_slug(s, d):
    return staged(s, d, "cues").select(KEY, "cue_ix", ck.slug(F.col("text")).alias("slug"))


def f7_tokens(s, d):
    c = staged(s, d, "cues").select(KEY, "cue_ix", F.explode(tx.content_tokens(F.col("text"))).alias("token"))
    return c.groupBy(KEY, "cue_ix", "token").agg(F.count(F.lit(1)).alias("n"))


def f8_last_sentence(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", tx.last_sentence(F.col("text")).alias("last"))


def f10_boxes(s, d):
    e = F.col("event_id")
    b = lambda k: bx.box(e * k % 300, e * (k + 2) % 200, 40 + e % 60, 30 + e % 50)
    u, o = bx.box_union(b(3), b(5)), bx.box_overlap(b(3), b(5))
    return table(s, d, "events").select("event_id", *[u[n].cast("long").alias(n) for n in "xywh"], _r(o).alias("overlap"))


def f11_f13(s, d):
    t = table(s, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("l"), F.count(F.lit(1)).alias("n"))
    band = ck.target_band(F.col("n").cast("double"))
    return t.select("conv_id", _r(band["low"]).alias("low"), _r(band["target"]).alias("target"), _r(band["high"]).alias("high"), ck.card_seconds(F.col("l")).alias("seconds"))


def f14_fingerprint(s, d):
    return staged(s, d, "cues").select(KEY, "cue_ix", ck.fingerprint(F.col("recording_id"), F.col("cue_ix")).alias("tag"))


def w1_sentences(s, d):
    x = tr.sentences(staged(s, d, "cues"))
    return x.select(KEY, "sent_ix", _r(F.col("start")).alias("start"), "text", "speaker")


def w1_sentences_across_cues(s, d):
    """Cues cut in half and nameless, so that sentences run over cue edges and across turns."""
    h = F.floor(F.length("text") / 2)
    halves = F.array(F.struct(F.lit(0).alias("k"), F.left("text", h).alias("t")), F.struct(F.lit(1).alias("k"), F.substring("text", h + 1, F.length("text")).alias("t")))
    c = staged(s, d, "cues").select(KEY, "cue_ix", "start", "end", F.explode(halves).alias("x"), F.lit(None).cast("string").alias("speaker"))
    c = c.select(KEY, (F.col("cue_ix") * 2 + F.col("x.k")).alias("cue_ix"), "start", "end", F.col("x.t").alias("text"), "speaker")
    x = tr.sentences(c)
    return x.select(KEY, "sent_ix", _r(F.col("start")).alias("start"), "text")


def w2_sentence_spans(s, d):
    x = tr.sentence_spans(staged(s, d, "timed_words"))
    return x.select(KEY, "first_word", "last_word", _r(F.col("start")).alias("start"), _r(F.col("end")).alias("end"), "speaker")


def w3_words_from_cues(s, d):
    x = tr.words_from_cues(staged(s, d, "cues"))
    return x.select(KEY, "word_ix", _r(F.col("start")).alias("start"), _r(F.col("end")).alias("end"), "text", _r(F.col("cut_start")).alias("cut_start"))


def j1_align_speakers(s, d):
    u = tb.utterances_from_cues(staged(s, d, "cues"))
    x = tr.align_speakers(_bare_cues(s, d), u)
    return x.select(KEY, "cue_ix", F.coalesce("speaker", F.lit("?")).alias("speaker"))


def j2_fill_speakers(s, d):
    c = staged(s, d, "cues").withColumn("speaker", F.when(F.col("cue_ix") % 3 == 0, F.col("speaker")))
    x = tr.fill_speakers(c)
    return x.select(KEY, "cue_ix", F.coalesce("speaker", F.lit("?")).alias("speaker"))


def _kept(s, d):
    """Segments per recording: its last third, then from a sixth to a half of it, as two kept stretches."""
    whole = staged(s, d, "cues").groupBy(KEY).agg(F.min("start").alias("a"), (F.max("end") - F.min("start")).alias("n"))
    at = lambda n, x, y: F.struct(F.lit(n).alias("seg_ix"), (F.col("a") + F.col("n") * x).alias("s_start"), (F.col("a") + F.col("n") * y).alias("s_end"))
    return whole.select(KEY, F.inline(F.array(at(0, 2 / 3, 1.0), at(1, 1 / 6, 1 / 2)))).where("s_end > s_start")


def j3_retime(s, d):
    x = tr.retime(staged(s, d, "cues"), _kept(s, d))
    return x.select(KEY, "seg_ix", "cue_ix", _r(F.col("start")).alias("start"), _r(F.col("end")).alias("end"))


def j4_talk_time(s, d):
    spans = _kept(s, d).withColumn("clip_ix", F.lit(0))
    x = tr.talk_time(spans, staged(s, d, "cues"), staged(s, d, "words"))
    return x.select(KEY, F.array_join("speakers", "|").alias("speakers"), _r(F.element_at("talk_seconds", 1)).alias("top"), "quote")


def j5_cues_in_moment(s, d):
    m = staged(s, d, "windows").select(KEY, F.col("i").alias("moment_ix"), (F.col("start") + 2).alias("m_start"), (F.col("end") - 2).alias("m_end"))
    return iv.cues_in_moment(m, staged(s, d, "cues")).select(KEY, "moment_ix", "cue_ix")


def j6_overlays_on_screen(s, d):
    o = staged(s, d, "cues").select(KEY, F.col("cue_ix").alias("overlay_ix"), "start", "end")
    return iv.overlays_on_screen(o, _kept(s, d)).select(KEY, "overlay_ix")


def j12_frames_in_segments(s, d):
    f = staged(s, d, "words").select(KEY, F.col("start").alias("ts"))
    segs = _kept(s, d).withColumn("s_offset", F.when(F.col("seg_ix") == 0, 0.0).otherwise(100.0))
    shown, _ = iv.frames_in_segments(f, segs)
    return shown.select(KEY, "seg_ix", _r(F.col("ts")).alias("ts"), _r(F.col("out_ts")).alias("out_ts"))


def j13_live_boxes(s, d):
    x = iv.live_boxes(staged(s, d, "boxes"), width=20000.0, chunk_seconds=86400.0)
    return x.select(KEY, _r(F.col("start"), 3).alias("start"), _r(F.col("end"), 3).alias("end"), F.size("boxes").cast("long").alias("live"))


def j14_overlap_seconds(s, d):
    a = iv.merge_intervals(staged(s, d, "intervals"), chunk_seconds=86400.0)
    x = iv.overlap_seconds(a, staged(s, d, "pauses"), 86400.0)
    return x.select(KEY, _r(F.col("seconds"), 2).alias("seconds"))


def u3_intersections(s, d):
    x = iv.intersections(staged(s, d, "intervals"), staged(s, d, "pauses"), 86400.0)
    return x.select(KEY, _r(F.col("start"), 3).alias("start"), _r(F.col("end"), 3).alias("end"))


def u4_jaccard(s, d):
    c = staged(s, d, "cues").select(KEY, "cue_ix", tx.content_set(F.col("text")).alias("w"))
    n = c.select(KEY, (F.col("cue_ix") - 1).alias("cue_ix"), F.col("w").alias("v"))
    return c.join(n, [KEY, "cue_ix"]).select(KEY, "cue_ix", _r(tx.jaccard(F.col("w"), F.col("v"))).alias("jaccard"))


def j16_best_sentence_for_terms(s, d):
    x = tr.best_sentence_for_terms(table(s, d, "conversations"), REQUEST)
    return x.select("conv_id", "turn", "sentence")


def a1_blocks(s, d):
    return tr.block_stats(staged(s, d, "cues"))


def a2_format_blocks(s, d):
    return tr.format_blocks(staged(s, d, "cues"))


def a3_dominant_speaker(s, d):
    x = tr.dominant_speaker(staged(s, d, "cues"))
    return x.select(KEY, "speaker", _r(F.col("seconds")).alias("seconds"))


def a4_top_topics(s, d):
    return tr.top_topics(staged(s, d, "cues")).select(KEY, "word", "lines", F.col("rank").cast("long").alias("rank"))


def a5_best_sentence(s, d):
    return tr.best_sentence(staged(s, d, "cues"), lex=PROSE)


def a8_kind_counts(s, d):
    b = staged(s, d, "boxes").withColumn("why", F.when(F.col("x") % 3 == 0, F.concat("why", F.lit(", manual"))).otherwise(F.col("why")))
    return pii.kind_counts(b)


def a9_coverage(s, d):
    x = pii.coverage(staged(s, d, "boxes"), 1920, 1080, bin_seconds=20000.0)
    return x.select(KEY, _r(F.col("start"), 3).alias("start"), _r(F.col("end"), 3).alias("end"), _r(F.col("share")).alias("share"))


def a10_large_blurs(s, d):
    x = pii.large_blurs(staged(s, d, "boxes"), 1920, 1080, 0.05, bin_seconds=20000.0)
    return x.select(KEY, _r(F.col("start"), 3).alias("start"), _r(F.col("end"), 3).alias("end"), _r(F.col("share")).alias("share"))


def _hours(s, d):
    spans = staged(s, d, "pauses").select(KEY, "start", "end")
    return spans.withColumn("span_ix", F.floor(F.col("start") * 1000))


def a11_peak_rms(s, d):
    sig = tb.signal_from_events(table(s, d, "events"))
    peak = sg.peak_levels(_hours(s, d), sig, 500.0, 86400.0)
    rms = sg.rms_levels(_hours(s, d), sig, "event_id", 4, 86400.0)
    return peak.join(rms.select(KEY, "span_ix", "rms"), [KEY, "span_ix"]).select(
        KEY, "span_ix", _r(F.col("peak_db"), 4).alias("peak_db"), _r(F.col("rms"), 4).alias("rms"))


def a12_changed_share(s, d):
    f = tb.frames_from_embeddings(table(s, d, "embeddings"))
    n = f.select(KEY, (F.col("ts") - 1).alias("ts"), F.col("thumb").alias("b"))
    return f.join(n, [KEY, "ts"]).select(
        KEY, "ts", _r(bx.changed_share(F.col("thumb"), F.col("b"))).alias("changed"), bx.max_diff(F.col("thumb"), F.col("b")).cast("long").alias("diff"))


def a13_first_sightings(s, d):
    from .functions.lexicon import SENSITIVE
    h = pii.find_sensitive(table(s, d, "documents"), ["doc_id", "lang"], kinds={"email": SENSITIVE["email"]})
    h = h.select(F.lit(0).alias(KEY), F.col("doc_id").cast("double").alias("t"), "kind", "match")
    return pii.first_sightings(h).select(KEY, "t", "kind", F.lower("match").alias("match"))


def a14_audit_report(s, d):
    return sg.audit_report(_readings(s, d))


def _readings(s, d):
    sig = tb.signal_from_events(table(s, d, "events"))
    segs = staged(s, d, "pauses").select(KEY, F.lit("clip").alias("clip"), F.floor(F.col("start") * 1000).alias("segment"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    return sg.audit_edges(segs, sig, None, 20000.0, 10000.0, 86400.0)


def j11_audit_edges(s, d):
    return _readings(s, d).select(KEY, "segment", "kind", _r(F.col("before_db"), 4).alias("before_db"), _r(F.col("after_db"), 4).alias("after_db"))


def a16_reconcile(s, d):
    w = staged(s, d, "words").select(F.col(KEY).alias("plan_id"), F.col("word_ix").alias("ix"), F.col("start").alias("ts"))
    got = w.where(F.col("ix") % 50 != 3).withColumn("ts", F.col("ts") + F.when(F.col("ix") % 40 == 1, 0.5).otherwise(0.001))
    extra = w.where(F.col("ix") % 60 == 7).withColumn("ix", F.col("ix") + 1000000)
    return sg.reconcile_timeline(w, got.unionByName(extra), 0.01).select("plan_id", "ix", "problem")


def s11_pair_intervals(s, d):
    return staged(s, d, "pauses").select(KEY, _r(F.col("start"), 3).alias("start"), _r(F.col("end"), 3).alias("end"))


def w5_merge_intervals(s, d):
    x = iv.merge_intervals(staged(s, d, "intervals"), chunk_seconds=86400.0)
    return x.select(KEY, _r(F.col("start"), 3).alias("start"), _r(F.col("end"), 3).alias("end"))


def w6_merge_silences(s, d):
    x = iv.merge_silences(staged(s, d, "pauses"), 7200.0, 3600.0)
    return x.select(KEY, _r(F.col("start"), 3).alias("start"), _r(F.col("end"), 3).alias("end"))


def w7_complement(s, d):
    i = staged(s, d, "intervals")
    spans = i.groupBy(KEY).agg((F.min("start") - 10).alias("start"), (F.max("end") + 10).alias("end"))
    x = iv.complement(spans, i, chunk_seconds=86400.0)
    return x.select(KEY, _r(F.col("start"), 3).alias("start"), _r(F.col("end"), 3).alias("end"))


def w8_word_runs(s, d):
    x = iv.word_runs(staged(s, d, "timed_words"))
    return x.select(KEY, _r(F.col("start")).alias("start"), _r(F.col("end")).alias("end"), "words")


def w18_overlay_runs(s, d):
    shown = staged(s, d, "words").select(KEY, F.col("word_ix").alias("out_ix"), F.col("start").alias("ts"), F.col("start").alias("out_ts"))
    o = staged(s, d, "cues").select(KEY, F.col("cue_ix").alias("overlay_ix"), "start", "end")
    x = iv.overlay_runs(o, shown)
    return x.select(KEY, "overlay_ix", _r(F.col("first")).alias("first"), _r(F.col("last")).alias("last"), "frames")


def w21_sample_times(s, d):
    return iv.sample_times(staged(s, d, "cues").select(KEY, F.floor("start").cast("double").alias("start"), F.floor(F.col("end") + 1).cast("double").alias("end")), 0.5)


def t1_best_window(s, d):
    x = pk.best_windows(staged(s, d, "cues"), REQUEST, 15, 60, 1)
    return x.select(KEY, "i", "j", _r(F.col("start")).alias("start"), _r(F.col("end")).alias("end"), _r(F.col("score"), 5).alias("score"))


def t1_best_windows(s, d):
    return staged(s, d, "windows").select(KEY, "i", "j", _r(F.col("start")).alias("start"), _r(F.col("end")).alias("end"), _r(F.col("score"), 5).alias("score"))


def _moments(s, d):
    none = F.array().cast("array<string>")
    w = staged(s, d, "takeaways").select(KEY, F.col("i").alias("moment_ix"), "start", "end", "takeaway")
    return w.withColumns({
        "title": tx.clip_text(F.col("takeaway"), 80), "lines": none, "why": F.lit("Key moment"), "lesson": F.lit(""), "context": F.lit(""),
        "segments": F.lit(None).cast("array<struct<a:double,b:double>>"),
    })


def _requests(s, d):
    """Spans that start and end anywhere: every cue, moved and stretched."""
    return staged(s, d, "cues").select(
        KEY, F.col("cue_ix").alias("req_ix"), (F.col("start") + 1.3).alias("start"), (F.col("end") + 17.7).alias("end"))


def _silences(s, d):
    """The gaps the timed words leave."""
    return staged(s, d, "annotated").where(F.col("gap_after") > 0.12).select(
        KEY, F.col("end").alias("start"), (F.col("end") + F.col("gap_after")).alias("end"))


def p10_filler_mask(s, d):
    lex = Lexicon(hard_fillers=("that", "le"), soft_fillers=("with", "de"))
    m = cuts.filler_mask(staged(s, d, "timed_words"), lex)
    return m.select(KEY, "word_ix", "filler")


def p13_validate_proposals(s, d):
    c = staged(s, d, "cues")
    p = c.select(KEY, F.col("cue_ix").alias("req_ix"), F.format_string("%.3f", "start").alias("start"),
        F.when(F.col("cue_ix") % 7 == 0, "soon").otherwise(F.format_string("%.3f", F.col("start") + F.col("cue_ix") * 3)).alias("end"),
        F.when(F.col("cue_ix") % 3 == 0, "8").alias("score"), F.col("text").alias("title"), F.lit("").alias("why"), F.lit("").alias("lesson"), F.lit("").alias("context"))
    return pk.validate_proposals(p, staged(s, d, "recordings")).select(
        KEY, "req_ix", _r(F.col("start"), 3).alias("start"), _r(F.col("end"), 3).alias("end"), "score", "title")


def p20_strip_annotations(s, d):
    c = staged(s, d, "cues")
    c = c.withColumn("text", F.concat(F.lit("("), F.col("speaker"), F.lit(")\n"), F.when(F.col("cue_ix") % 4 == 0, F.lit("-")).otherwise(F.col("text")), F.lit("\n--")))
    return tr.strip_annotations(c).select(KEY, "cue_ix", "text")


def p23_preset_bounds(s, d):
    plans = staged(s, d, "reel_plans").withColumn("plan", F.col("plan").withField("output", F.col("plan.output").withField("preset", F.lit("shorts"))))
    clips = F.transform("plan.clips", lambda c: c.withField("segments", F.concat(c["segments"], c["segments"])))
    plans = plans.withColumn("plan", F.col("plan").withField("clips", clips))
    return cards.preset_bounds_check(plans, KEY).select(KEY, "clip_id", _r(F.col("seconds"), 3).alias("seconds"))


def p24_detection_spans(s, d):
    m = cuts.detection_spans(staged(s, d, "windows"))
    return m.select(KEY, "i", _r(F.col("detect_start")).alias("detect_start"), _r(F.col("detect_end")).alias("detect_end"))


def j8_neighbours(s, d):
    x = cuts.neighbours(_requests(s, d), staged(s, d, "annotated"))
    return x.select(KEY, "req_ix", _r(F.col("prev_word_end")).alias("prev_word_end"), _r(F.col("next_word_start")).alias("next_word_start"))


def j8_speech_edges(s, d):
    x = cuts.speech_edges(_requests(s, d), staged(s, d, "annotated"))
    return x.select(KEY, "req_ix", _r(F.col("first")).alias("first"), _r(F.col("last")).alias("last"))


def j9_snap_to_sentences(s, d):
    x = cuts.snap_to_sentences(_requests(s, d), staged(s, d, "sentence_spans"))
    return x.select(KEY, "req_ix", _r(F.col("snap_start")).alias("snap_start"), _r(F.col("snap_end")).alias("snap_end"))


def j10_snap_to_words(s, d):
    x = cuts.snap_to_words(_requests(s, d), staged(s, d, "annotated"))
    return x.select(KEY, "req_ix", _r(F.col("snap_start")).alias("snap_start"), _r(F.col("snap_end")).alias("snap_end"))


def w4_finish_thought(s, d):
    e = staged(s, d, "sentence_spans").select(KEY, F.col("first_word").alias("req_ix"), "end")
    x = cuts.finish_after_sentences(e, staged(s, d, "sentence_spans"), lex=Lexicon(setup_patterns=(r"\b(?:is|the|le|der)\b",)))
    return x.select(KEY, "req_ix", _r(F.col("end")).alias("end"), _r(F.col("finished")).alias("finished"))


def w14_cut_moments(s, d):
    lex = Lexicon(hard_fillers=("that", "le", "de"))
    x = cuts.cut_moments(_requests(s, d), staged(s, d, "timed_words"), _silences(s, d), annotated=staged(s, d, "annotated"), lex=lex)
    return x.select(KEY, "req_ix", "fillers", "embedded", "intact", F.size("segments").alias("segments"), _r(F.col("silence_seconds")).alias("silence_seconds"))


def a7_cut_totals(s, d):
    lex = Lexicon(hard_fillers=("that", "le", "de"))
    return cuts.cut_totals(cuts.cut_moments(_requests(s, d), staged(s, d, "timed_words"), None, lex=lex))


def w15_resolve_overlaps(s, d):
    m, _ = pk.resolve_overlaps(_requests(s, d).withColumnRenamed("req_ix", "moment_ix"), staged(s, d, "recordings"))
    return m.select(KEY, "moment_ix", _r(F.col("start")).alias("start"), _r(F.col("end")).alias("end"))


def w16_merge_boxes(s, d):
    return pii.merge_boxes(staged(s, d, "boxes"))


def w17_screen_runs(s, d):
    return pii.screen_runs(tb.frames_from_embeddings(table(s, d, "embeddings")), still=0.4)


def a15_chunk_blocks(s, d):
    return tr.chunk_blocks(tr.format_blocks(staged(s, d, "cues")), 2000).select(KEY, "block", "chunk")


def t2_candidate_windows(s, d):
    snapped = staged(s, d, "cues").withColumns({"s_start": F.col("start"), "s_end": F.col("end")})
    x = pk.candidate_windows(snapped, 15, 60, 30.0, PROSE)
    return x.select(KEY, "i", F.col("kind").cast("long").alias("kind"), "last", _r(F.col("start")).alias("start"), _r(F.col("end")).alias("end"), _r(F.col("score"), 5).alias("score"))


def t3_pick_moments(s, d):
    return pk.pick_moments(staged(s, d, "cues"), 1.5, lex=PROSE).select(KEY, "moment_ix", "start", "end", "title", "why")


def t4_executive_summary(s, d):
    return pk.executive_summary(staged(s, d, "cues"), lex=PROSE).select(KEY, "sent_ix", _r(F.col("start")).alias("start"), "text")


def t5_fit_moments(s, d):
    m = _requests(s, d).withColumnRenamed("req_ix", "moment_ix").withColumn("score", F.col("moment_ix") % 7)
    return pk.fit_moments(m, 1.5).select(KEY, "moment_ix")


def t6_moments_from_specs(s, d):
    return pk.moments_from_specs(_requests(s, d).withColumn("lines", F.array().cast("array<string>")), staged(s, d, "cues"), lex=PROSE).select(
        KEY, "moment_ix", "start", "end", "title", "takeaway", "why")


def t9_build_plan(s, d):
    p = build.build_plan(staged(s, d, "takeaways"), staged(s, d, "recordings"))
    c = p.select(KEY, F.explode("plan.clips").alias("c"))
    return c.select(KEY, F.col("c.id").alias("clip_id"), "c.takeaway", F.col("c.segments")[0]["start"].alias("start"), F.col("c.segments")[0]["end"].alias("end"))


def a6_plan_runtime(s, d):
    return staged(s, d, "reel_plans").select(KEY, _r(cards.plan_runtime(F.col("plan")), 3).alias("seconds"))


def w19_timeline(s, d):
    return cards.timeline(staged(s, d, "reel_plans"), KEY).select(KEY, "item_ix", "role", _r(F.col("start"), 3).alias("start"), _r(F.col("seconds"), 3).alias("seconds"))


def w20_card_runs(s, d):
    return cards.card_runs(staged(s, d, "reel_plans"), 24, 1, KEY)


def w22_effective_transition(s, d):
    """What the picked windows of each recording can afford of twenty seconds."""
    g = staged(s, d, "windows").groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("w"))
    kind = F.when(F.col(KEY) % 3 == 0, "cut").when(F.col(KEY) % 3 == 1, "dissolve").otherwise("dip")
    return g.select(KEY, _r(cards.effective_transition(kind, F.lit(20.0), F.transform("w", lambda x: x["end"] - x["start"])), 5).alias("seconds"))


def v1_violations(s, d):
    """Plans with planted faults: a long takeaway, a wrong preset, a segment past the end, an unknown key."""
    p = staged(s, d, "reel_plans").select(F.col(KEY).alias("plan_id"), "plan_json")
    n, j = F.col("plan_id") % 5, F.col("plan_json")
    broken = (
        F.when(n == 0, F.regexp_replace(j, '"takeaway":"', '"takeaway":"' + "x" * 201)).when(n == 1, F.replace(j, F.lit('"internal"'), F.lit('"wide"')))
        .when(n == 2, F.regexp_replace(j, '"duration_seconds":[0-9.]+', '"duration_seconds":0.5')).when(n == 3, F.replace(j, F.lit('"version"'), F.lit('"fps":30,"version"')))
        .otherwise(j)
    )
    v = validate.violations(p.withColumn("plan_json", broken))
    return v.groupBy("plan_id", "rule").agg(F.count(F.lit(1)).alias("faults"))


def s3_srt_blocks(s, d):
    return cp.srt_blocks(staged(s, d, "cues"), strict=True).select(KEY, "cue_ix", "line")


def s13_resolve_captions(s, d):
    c = staged(s, d, "cues")
    got, _ = cp.resolve_captions(c.where(F.col(KEY) % 3 == 0), c.where(F.col(KEY) % 2 == 0), c.where(F.col(KEY) % 5 == 0), staged(s, d, "recordings"))
    return got.groupBy(KEY, "captions_kind").agg(F.count(F.lit(1)).alias("cues"))


def s16_incremental_filter(s, d):
    c = staged(s, d, "cues").select(KEY, "cue_ix")
    seen = rc.incremental_filter(c.where(F.col("cue_ix") % 2 == 1), c.select(F.lit("").alias("fingerprint")), [KEY, "cue_ix"])
    return rc.incremental_filter(c, seen, [KEY, "cue_ix"]).select(KEY, "cue_ix")


def q1_plan(s, d):
    plans, _ = jobs.plan(staged(s, d, "cues"), staged(s, d, "recordings"), REQUEST, k=2)
    return plans.select(KEY, "plan_json")


def q2_summarize(s, d):
    return jobs.summary_lines(staged(s, d, "cues"), staged(s, d, "recordings"), staged(s, d, "reel_plans"), lex=PROSE)


def q3_outline(s, d):
    return jobs.outline_lines(staged(s, d, "cues"), staged(s, d, "recordings"))


def q4_reel(s, d):
    lex = Lexicon(hard_fillers=("that", "le", "de"))
    block = F.floor(F.col("start") / 30)  # a hand-picked moment for every half minute of talk
    specs = staged(s, d, "cues").groupBy(KEY, block.cast("long").alias("req_ix")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    specs = specs.withColumn("lines", F.array().cast("array<string>"))
    r = jobs.reel(staged(s, d, "cues"), staged(s, d, "recordings"), 1.5, staged(s, d, "timed_words"), _silences(s, d), specs=specs, lex=lex)
    return r.plans.select(KEY, "plan_json", "runtime")


def q5_audit_plan(s, d):
    w = staged(s, d, "words")
    sig = w.select(KEY, F.col("start").alias("t"), (F.length("text") * 1000).cast("double").alias("value"))
    _, report = jobs.audit_plan(staged(s, d, "reel_plans"), sig, w, window=0.5)
    return report


def q6_storyboard(s, d):
    x = jobs.storyboard(staged(s, d, "reel_plans"), staged(s, d, "cues"), staged(s, d, "words"))
    return x.select(KEY, "item_ix", "role", "title", _r(F.col("start"), 3).alias("start"), F.array_join("speakers", "|").alias("speakers"), "quote")


def q7_redact_text(s, d):
    return jobs.redact_text(table(s, d, "documents")).select("doc_id", "masked", F.sha2("clean", 256).alias("clean_hash"))


def q8_check_redaction(s, d):
    clean, quarantine = jobs.check_redaction(table(s, d, "documents"), ["doc_id"])
    return clean.select("doc_id", F.lit("clean").alias("state")).unionByName(quarantine.select("doc_id", F.lit("quarantine").alias("state")))


def _as_text(rows, ix, line, sep="\n"):
    """One text a recording, its lines in order: a file as a row."""
    told = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ix).alias("k"), F.col(line).alias("v")))), lambda x: x["v"])
    return rows.groupBy(KEY).agg(F.array_join(told, sep).alias("text"))


def s1_read_srt(s, d):
    c = staged(s, d, "cues").withColumn("text", F.concat(F.lit("("), "speaker", F.lit(")\n"), "text"))
    x = cp.parse_srt(_as_text(cp.srt_blocks(c), "cue_ix", "line"))
    return x.select(KEY, F.col("cue_ix").cast("long").alias("cue_ix"), _r(F.col("start"), 3).alias("start"), _r(F.col("end"), 3).alias("end"), "text", "speaker")


def _strict(s, d):
    """Every tenth cue ends when it starts."""
    c = staged(s, d, "cues").withColumn("end", F.when(F.col("cue_ix") % 10 == 3, F.col("start")).otherwise(F.col("end")))
    return cp.parse_srt_strict(_as_text(cp.srt_blocks(c), "cue_ix", "line"))


def s2_strict_cues(s, d):
    return _strict(s, d)[0].select(KEY, F.col("cue_ix").cast("long").alias("cue_ix"), _r(F.col("start"), 3).alias("start"), _r(F.col("end"), 3).alias("end"), "text")


def s2_strict_rejects(s, d):
    return _strict(s, d)[1].select(KEY, F.col("record_ix").cast("long").alias("record_ix"))


def s4_read_words(s, d):
    """The timed words as a JSON list, with a row that has no word after every tenth."""
    w = staged(s, d, "timed_words").withColumn("line", F.concat(
        F.to_json(F.struct("start", "end", F.col("text").alias("word"))), F.when(F.col("word_ix") % 10 == 0, ',{"start":1,"end":2,"word":" "}').otherwise("")))
    text = _as_text(w, "word_ix", "line", ",").withColumn("text", F.concat(F.lit("["), "text", F.lit("]")))
    return rc.parse_words(text)[0].select(KEY, "word_ix", _r(F.col("start")).alias("start"), _r(F.col("end")).alias("end"), "text")


def s6_read_notes(s, d):
    """A time line for every two turns, and the turns as spoken lines."""
    t = table(s, d, "conversations").select(F.col("conv_id").alias(KEY), "turn", F.initcap("role").alias("who"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("said"))
    block = F.floor(F.col("turn") / 2)
    head = F.when(F.col("turn") % 2 == 0, F.concat(F.format_string("0:%02d:00", block), F.lit("\n"))).otherwise("")
    x = rc.parse_notes(_as_text(t.withColumn("line", F.concat(head, "who", F.lit(": "), "said")), "turn", "line"))
    return x.select(KEY, F.col("utt_ix").cast("long").alias("utt_ix"), _r(F.col("time")).alias("time"), "speaker", "text")


def s9_read_specs(s, d):
    """Requests as JSON records; every fourth one ends before it starts."""
    r = _requests(s, d).withColumn("end", F.when(F.col("req_ix") % 4 == 1, F.col("start") - 1).otherwise(F.col("end")))
    line = F.to_json(F.struct("start", "end", F.lit("T").alias("title"), F.array(F.lit("a"), F.lit("b")).alias("lines")))
    text = _as_text(r.withColumn("line", line), "req_ix", "line", ",").withColumn("text", F.concat(F.lit("["), "text", F.lit("]")))
    good, bad = rc.parse_moment_specs(text)
    good = good.select(KEY, F.col("req_ix").cast("long").alias("req_ix"), _r(F.col("start")).alias("start"), _r(F.col("end")).alias("end"), F.concat_ws("|", "title", F.array_join("lines", "|")).alias("card"))
    none = F.lit(None).cast("double")
    return good.unionByName(bad.select(KEY, F.col("record_ix").cast("long").alias("req_ix"), none.alias("start"), none.alias("end"), F.lit("rejected").alias("card")))


def s12_media_facts(s, d):
    n = F.col(KEY)
    streams = F.when(n % 3 == 0, '{"codec_type":"video"},{"codec_type":"subtitle"}').otherwise('{"codec_type":"audio"}')
    duration = F.when(n % 5 == 0, "").otherwise(F.format_string("%.3f", "duration_seconds"))
    p = staged(s, d, "recordings").select(KEY, F.concat(F.lit('{"format":{"duration":"'), duration, F.lit('"},"streams":['), streams, F.lit("]}")).alias("probe_json"))
    good, bad = rc.media_facts(p)
    good = good.select(KEY, "duration_seconds", "has_video", "has_audio", F.col("subtitle_stream_index").cast("long").alias("subtitle"))
    return good.unionByName(bad.select(KEY, F.lit(0.0).alias("duration_seconds"), F.lit(False).alias("has_video"), F.lit(False).alias("has_audio"), F.lit(-1).cast("long").alias("subtitle")))


def f4_hms_tenths(s, d):
    return staged(s, d, "cues").select(KEY, "cue_ix", ck.hms_tenths(F.col("start") * 37).alias("stamp"))


def f9_trim_words(s, d):
    return staged(s, d, "cues").select(KEY, "cue_ix", tx.trim_words(F.col("text"), F.lit(0.25), F.lit(0.75)).alias("text"))


def p8_tidy_sentence(s, d):
    return staged(s, d, "cues").select(KEY, "cue_ix", tx.tidy_sentence(F.col("text"), PROSE).alias("tidy"))


def p21_pad(s, d):
    a, b = cuts.pad(F.col("start"), F.col("end"), duration=F.col("duration_seconds"))
    r = _requests(s, d).join(staged(s, d, "recordings").select(KEY, "duration_seconds"), KEY)
    return r.select(KEY, "req_ix", _r(a).alias("start"), _r(b).alias("end"))


def v2_story_faults(s, d):
    """Moment specs with planted faults: an overlay outside, a wrong corner, an unknown key, none."""
    n = F.col("cue_ix") % 4
    more = (
        F.when(n == 0, '"overlays":[{"start":9000,"end":9001,"text":"x"}]').when(n == 1, '"layout":{"kind":"pip","screen":[0,0,1,1],"corner":"middle"}')
        .when(n == 2, '"colour":"red"').otherwise('"cards":[{"title":"a"}],"layout":"full"')
    )
    record = F.format_string('{"start":%.3f,"end":%.3f,%s}', "start", F.col("end") + 1, more)
    c = staged(s, d, "cues").select((F.col(KEY) * 100000 + F.col("cue_ix")).alias("spec_id"), record.alias("record"))
    return validate.validate_story(c).select("spec_id", "rule")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    n: f for n, f in list(globals().items())
    if callable(f) and n[0] in "pfwjuatsvq" and n.split("_")[0][1:].isdigit() or n in ("f_clocks", "f11_f13")
}
