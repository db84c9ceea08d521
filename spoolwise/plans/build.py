"""Plans from windows or moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock as ck, text as tx
from ..functions.let import let
from ..operators.cuts import LEAD, TAIL, pad
from ..operators.scans import KEY, cut_lineage
from .cards import TITLE_LIMIT, closing_cards, moment_card, opening_card, outro_card, plan_runtime
from .schema import CARD, PLAN, PRESET_ASPECT

INTRO_SECONDS, TRANSITION_SECONDS, AUDIO_FADE_SECONDS = 4.0, 0.4, 0.15
SETTINGS = (
    "struct<title:string,date:string,what_you_will_learn:array<string>,takeaways:array<string>,"
    "outro:struct<title:string,lines:array<string>>,opening_seconds:double,closing_seconds:double,outro_seconds:double,"
    "music_gain_db:double,music_fade_seconds:double,transition:string,style:string,audio_fade_seconds:double,layout:string,"
    "music_at:string,theme:string>"
)


def _source(kind: str, srt: Column | None) -> Column:
    captions = F.struct(F.lit(kind).alias("kind"), (srt if srt is not None else F.lit(None).cast("string")).alias("path"))
    return F.struct(F.col("path"), F.round("duration_seconds", 3).alias("duration_seconds"), captions.alias("captions"))


def _as_plan(d: DataFrame, reel: Column, preset: str, captions_kind: str, out_dir: str, summary: str | None) -> DataFrame:
    null = F.lit(None).cast("string")
    output = F.struct(
        F.lit(out_dir).alias("dir"), F.lit(preset).alias("preset"), F.lit(PRESET_ASPECT[preset]).alias("aspect"),
        F.lit("none" if captions_kind == "none" else "burn_in").alias("captions"), null.alias("container"),
        F.lit(None).cast("int").alias("max_height"), reel.alias("reel"),
    )
    plan = F.struct(
        F.lit("1").alias("version"), _source(captions_kind, null).alias("source"), output.alias("output"),
        F.col("clips"), F.when(F.lit(summary).isNotNull(), F.struct(F.lit(summary).cast("string").alias("path"))).alias("summary"),
    ).cast(PLAN)
    return d.withColumn("plan", plan)


def _clip(n: Column, takeaway: Column, segments: Column, card: Column, cards: Column | None = None, overlays: Column | None = None, layout: Column | None = None) -> Column:
    null = lambda t: F.lit(None).cast(t)
    from .schema import LAYOUT, OVERLAY
    return F.struct(
        F.concat(F.format_string("clip-%02d-", n), ck.slug(takeaway)).alias("id"), takeaway.alias("takeaway"), segments.alias("segments"),
        null("double").alias("hook_offset_seconds"), F.lit(True).alias("trim_silence"), null("string").alias("crop_focus"), card.alias("card"),
        (cards if cards is not None else null(f"array<{CARD}>")).alias("cards"), (layout if layout is not None else null(LAYOUT)).alias("layout"),
        (overlays if overlays is not None else null(f"array<{OVERLAY}>")).alias("overlays"),
    )


def build_plan(windows: DataFrame, recordings: DataFrame, preset: str = "internal", captions_kind: str = "embedded", out_dir: str = "out", summary: str | None = None) -> DataFrame:
    """One plan per recording from its picked windows (recording_id, start, end, takeaway); at most 50 clips each.

    ``recordings``: recording_id, path, duration_seconds. Gives recording_id, plan.
    """
    g = windows.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end", "takeaway"))).alias("_w"))
    segment = lambda w: F.array(F.struct(F.round(w["start"], 3).alias("start"), F.round(w["end"], 3).alias("end")))
    clips = F.transform("_w", lambda w, k: _clip(k + 1, w["takeaway"], segment(w), F.lit(None).cast(CARD)))
    d = g.join(recordings.select(KEY, "path", "duration_seconds"), KEY).withColumn("clips", clips)
    from .schema import REEL
    return _as_plan(d, F.lit(None).cast(REEL), preset, captions_kind, out_dir, summary).select(KEY, "plan")


def settings_of(raw: DataFrame, text: str = "settings_json") -> DataFrame:
    """Per-recording settings as a typed ``settings`` column; validate the text with ``validate_settings`` first."""
    s = F.from_json(text, SETTINGS)
    tr = F.col("_s.transition")
    obj = F.startswith(F.ltrim(tr), F.lit("{"))
    return raw.withColumn("_s", s).select(
        KEY, F.col("_s").alias("settings"), F.when(obj, F.get_json_object(tr, "$.kind")).otherwise(tr).alias("transition_kind"),
        F.when(obj, F.get_json_object(tr, "$.seconds").try_cast("double")).alias("transition_seconds"),
    )


def build_reel_plan(
    moments: DataFrame, recordings: DataFrame, takeaways: DataFrame | None = None, settings: DataFrame | None = None,
    preset: str = "internal", captions_kind: str = "embedded", out_dir: str = "out", summary: str = "summary.md",
    transition: str = "dip", music: str | None = None, lead: float = LEAD, tail: float = TAIL,
) -> DataFrame:
    """One reel plan per recording.

    ``moments``: recording_id, moment_ix, start, end, takeaway, title, lines, why, lesson, context, segments
    (``array<struct<a,b>>``, null or empty: the whole moment with air), optional cards, overlays, layout, image and qr.
    ``recordings``: recording_id, path, duration_seconds, title, date. ``takeaways``: recording_id, takeaways (lines).
    A setting wins wherever it says something; every card has its final seconds before the runtime is written.
    """
    from .schema import LAYOUT, OVERLAY
    for name, kind in (("cards", f"array<{CARD}>"), ("overlays", f"array<{OVERLAY}>"), ("layout", LAYOUT), ("image", "string"), ("qr", "string")):
        if name not in moments.columns:
            moments = moments.withColumn(name, F.lit(None).cast(kind))
    duration = recordings.select(KEY, F.col("duration_seconds").alias("_dur"))
    s, e = pad(F.col("start"), F.col("end"), lead, tail, F.col("_dur"))
    whole = F.array(F.struct(s.alias("a"), e.alias("b")))
    kept = F.when(F.coalesce(F.size("segments"), F.lit(0)) > 0, F.col("segments")).otherwise(whole)
    m = moments.join(duration, KEY).withColumn(
        "_seg", F.transform(kept, lambda x: F.struct(F.round(x["a"], 3).alias("start"), F.round(x["b"], 3).alias("end")))
    )
    on = F.filter("overlays", lambda o: F.exists("_seg", lambda g: (o["start"] < g["end"]) & (o["end"] > g["start"])))
    m = m.select(
        KEY, "moment_ix", "takeaway", "lesson", "title", "_seg", "cards", F.when(F.size(on) > 0, on).alias("_over"), "layout",
        moment_card(F.col("title"), F.col("lines"), F.col("why"), F.col("lesson"), F.col("context"), F.col("image"), F.col("qr")).alias("_card"),
    )
    g = m.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(*[c for c in m.columns if c != KEY]))).alias("_m"))
    d = g.join(recordings.select(KEY, "path", "duration_seconds", "title", "date"), KEY)
    d = d.withColumn("clips", F.transform("_m", lambda x, k: _clip(k + 1, x["takeaway"], x["_seg"], x["_card"], x["cards"], x["_over"], x["layout"])))
    if takeaways is not None:
        d = d.join(takeaways.select(KEY, "takeaways"), KEY, "left")
    else:
        d = d.withColumn("takeaways", F.lit(None).cast("array<string>"))
    if settings is not None:
        d = d.join(settings.select(KEY, "settings", "transition_kind", "transition_seconds"), KEY, "left")
    else:
        null = F.lit(None)
        d = d.withColumns({"settings": null.cast(SETTINGS), "transition_kind": null.cast("string"), "transition_seconds": null.cast("double")})
    fr, none = F.col("settings"), F.array().cast("array<string>")
    title, date = F.coalesce(fr["title"], F.col("title")), F.coalesce(fr["date"], F.col("date"))
    said = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    taught = F.transform("_m", lambda x: F.coalesce(F.nullif(x["lesson"], F.lit("")), x["title"]))
    opening = opening_card(F.when(said(fr["what_you_will_learn"]), fr["what_you_will_learn"]).otherwise(taught), title)
    opening = let(opening, lambda c: c.withField("seconds", F.coalesce(fr["opening_seconds"], c["seconds"])))
    closing = closing_cards(
        F.coalesce(F.when(said(fr["takeaways"]), fr["takeaways"]).otherwise(F.col("takeaways")), none),
        F.when(said(fr["takeaways"]), F.lit(3)).otherwise(F.lit(2)),
    )
    closing = F.transform(closing, lambda c: c.withField("seconds", F.coalesce(fr["closing_seconds"], c["seconds"])))
    own = fr["outro"]
    from .cards import card
    outro = F.when(
        own["title"].isNotNull(), card(own["title"], F.coalesce(own["lines"], none), ck.card_seconds(F.coalesce(own["lines"], none)))
    ).otherwise(outro_card(summary))
    outro = outro.withField("seconds", F.coalesce(fr["outro_seconds"], outro["seconds"]))
    head = F.coalesce(F.nullif(tx.clip_text(title, TITLE_LIMIT), F.lit("")), F.lit("Summary"))
    # the cards are read many times below: they are worked out once, and the plan holds columns instead of their expressions
    d = cut_lineage(d.select(
        KEY, "path", "duration_seconds", F.size("_m").alias("_moments"), "clips", "settings", "transition_kind", "transition_seconds",
        head.alias("_head"), date.alias("_date"), opening.alias("_opening"), closing.alias("_closing"), outro.alias("_outro"),
    ))
    opening, closing = F.col("_opening"), F.col("_closing")
    music_t = "struct<path:string,under:string,gain_db:double,duck_db:double,fade_seconds:double,loop:boolean>"
    null = F.lit(None)
    bed = null.cast(music_t) if not music else F.struct(
        F.lit(music).alias("path"), null.cast("string").alias("under"), fr["music_gain_db"].alias("gain_db"), null.cast("double").alias("duck_db"),
        fr["music_fade_seconds"].alias("fade_seconds"), null.cast("boolean").alias("loop"),
    )

    def reel(lines: Column) -> Column:
        return F.struct(
            F.lit("reel.mp4").alias("filename"), card(F.col("_head"), lines, F.lit(INTRO_SECONDS)).alias("intro"), F.col("_outro").alias("outro"),
            F.lit("all").alias("chapter_cards"), F.when(opening.isNotNull(), F.array(opening)).alias("opening"),
            F.when(F.size(closing) > 0, closing).alias("closing"), bed.alias("music"),
            F.struct(
                F.coalesce(F.col("transition_kind"), F.lit(transition)).alias("kind"),
                F.coalesce(F.col("transition_seconds"), F.lit(TRANSITION_SECONDS)).alias("seconds"), null.cast("string").alias("module"),
            ).alias("transition"),
            F.coalesce(fr["audio_fade_seconds"], F.lit(AUDIO_FADE_SECONDS)).alias("audio_fade_seconds"),
        )

    d = _as_plan(d, reel(none), preset, captions_kind, out_dir, summary)
    total = F.rint(plan_runtime(F.col("plan")))
    lines = F.array(F.concat(F.lit("Recorded "), F.col("_date")), F.concat(F.col("_moments").cast("string"), F.lit(" moments · "), ck.ts(total)))
    plan = F.col("plan")
    new_reel = plan["output"]["reel"].withField("intro", plan["output"]["reel"]["intro"].withField("lines", lines))
    plan = plan.withField("output", plan["output"].withField("reel", new_reel))
    return d.select(KEY, plan.alias("plan"))


def plan_documents(plans: DataFrame) -> DataFrame:
    """Plans as JSON text; fields without a value are left out."""
    return plans.withColumn("plan_json", F.to_json("plan"))


def write_plans(plans: DataFrame, path: str, mode: str = "errorifexists") -> None:
    out = plan_documents(plans).select(KEY, F.col("plan_json").alias("value"))
    out.repartition(KEY).write.mode(mode).partitionBy(KEY).text(path)
