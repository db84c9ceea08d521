"""User-level jobs: compositions of the operators, one DataFrame per result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .functions import clock as ck, text as tx
from .functions.lexicon import ENGLISH, Lexicon
from .operators import cuts, picks, pii, signal, transcript as tr
from .operators.scans import KEY, cut_lineage
from .plans import build, cards, validate
from .plans.schema import PRESET_BOUNDS


def plan(
    cues: DataFrame, recordings: DataFrame, request: str, preset: str = "internal", k: int = 1, lo: float | None = None,
    hi: float | None = None, lex: Lexicon = ENGLISH,
) -> tuple[DataFrame, DataFrame]:
    """Q1: the plan of each recording that has something to show for the request, and the faults found in the plans."""
    low, high = PRESET_BOUNDS[preset]
    windows = picks.best_windows(cues, request, lo if lo is not None else low, hi if hi is not None else high, k, lex)
    windows = picks.window_takeaways(windows, cues, request, lex=lex)
    plans = build.plan_documents(build.build_plan(windows, recordings, preset)).withColumnRenamed(KEY, "plan_id")
    plans = cut_lineage(plans)
    return plans.withColumnRenamed("plan_id", KEY), validate.violations(plans)


def labelled(cues: DataFrame, notes: DataFrame | None, offset: float = 0.0) -> DataFrame:
    """Speakers from meeting notes, then from agreeing neighbours."""
    return tr.fill_speakers(cut_lineage(tr.align_speakers(cues, notes, offset))) if notes is not None else cues


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def summary_lines(
    cues: DataFrame, recordings: DataFrame, plans: DataFrame | None = None, focus: Column | None = None, lex: Lexicon = ENGLISH
) -> DataFrame:
    """The summary document as ordered lines (recording_id, part, ix, line).

    ``recordings``: recording_id, title, path, duration_seconds. The transcript stays rows: nothing gathers a recording.
    """
    one = lambda part, line, ix=0: (F.lit(part).alias("part"), F.lit(ix).cast("long").alias("ix"), line.alias("line"))
    n = cues.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    r = recordings.join(n, KEY, "left")
    info = _line("Source: `", F.col("path"), "` · ", ck.ts(F.col("duration_seconds")), " long · ", F.coalesce("_n", F.lit(0)).cast("string"), " caption cues")
    head = F.array(_line("# ", F.col("title")), F.lit(""), info, F.lit(""))
    out = r.select(KEY, F.lit(0).alias("part"), F.posexplode(head).alias("ix", "line")).withColumn("ix", F.col("ix").cast("long"))
    best = picks.executive_summary(cues, focus=focus, lex=lex)
    who = F.coalesce(F.concat(tr.named(F.col("speaker")), F.lit(": ")), F.lit(""))
    out = out.unionByName(recordings.select(KEY, *one(2, F.lit("## Executive summary\n"))))
    out = out.unionByName(best.select(KEY, F.lit(3).alias("part"), F.col("sent_ix").cast("long").alias("ix"), _line("- [", ck.ts(F.col("start")), "] ", who, F.col("text")).alias("line")))
    bare = recordings.join(best.select(KEY).distinct(), KEY, "left_anti")
    out = out.unionByName(bare.select(KEY, *one(3, F.lit("- (no summarizable speech found)"))))
    if plans is not None:
        reel = F.col("plan.output.reel")
        closing = F.flatten(F.transform(reel["closing"], lambda c: c["lines"]))
        tk = plans.where(F.size(closing) > 0).select(KEY, F.lit(1).alias("part"), F.posexplode(F.concat(F.array(F.lit("## Takeaways\n")), F.transform(closing, lambda x: _line("- ", x)), F.array(F.lit("")))).alias("ix", "line"))
        span = lambda s: _line(ck.ts(s["start"]), "–", ck.ts(s["end"]))

        def chapter(c: Column, k: Column) -> Column:
            why = F.array_join(F.coalesce(c["card"]["lines"], F.array().cast("array<string>")), "; ")
            return _line(
                (k + 1).cast("string"), ". [", F.array_join(F.transform(c["segments"], span), " + "), "] **", F.coalesce(c["card"]["title"], c["takeaway"]),
                "**", F.when(why != "", _line(" — ", why)).otherwise(F.lit("")), " (`", c["id"], "`)",
            )

        def clip(c: Column) -> Column:
            return _line("- **", c["id"], "** [", F.array_join(F.transform(c["segments"], span), " + "), "] (", ck.ts(cards.kept_seconds(c)), ") — ", c["takeaway"])

        intro = F.when(reel["intro"].isNotNull(), F.array(_line("Intro: **", reel["intro"]["title"], "** — ", F.array_join(F.coalesce(reel["intro"]["lines"], F.array().cast("array<string>")), " · "), "\n")))
        opened = F.concat(F.array(F.lit("\n## Reel\n")), F.coalesce(intro, F.array().cast("array<string>")))
        listed = F.when(reel.isNotNull(), F.concat(opened, F.transform("plan.clips", chapter))).otherwise(
            F.concat(F.array(F.lit("\n## Clips\n")), F.transform("plan.clips", clip))
        )
        out = out.unionByName(tk.withColumn("ix", F.col("ix").cast("long")))
        out = out.unionByName(plans.select(KEY, F.lit(4).alias("part"), F.posexplode(listed).alias("ix", "line")).withColumn("ix", F.col("ix").cast("long")))
    out = out.unionByName(recordings.select(KEY, *one(5, F.lit("\n## Full transcript\n"))))
    from .operators.scans import with_neighbours
    c = with_neighbours(cues, "cue_ix", prev=("speaker",))
    new = F.col("_prev").isNull() & F.col("speaker").isNotNull() | (F.col("_prev").isNotNull() & ~F.col("_prev.speaker").eqNullSafe(F.col("speaker")))
    heading = F.when(new, _line("\n**", F.coalesce(tr.named(F.col("speaker")), F.lit("Speaker")), "**\n")).otherwise(F.lit(""))
    said = _line(heading, "- [", ck.ts(F.col("start")), "] ", F.col("text"))
    return out.unionByName(c.select(KEY, F.lit(6).alias("part"), F.col("cue_ix").cast("long").alias("ix"), said.alias("line")))


SKELETON = (
    '[\n  {\n    "start": "0:00:00",\n    "end": "0:00:30",\n    "title": "Card title, <= 80 chars (also the clip takeaway)",\n'
    '    "lines": [\n      "Optional card line, <= 120 chars, up to 4"\n    ],\n'
    '    "why": "Optional: Decision / Demo / Q&A / who is speaking; the card line when `lines` is empty"\n  }\n]'
)


def outline_lines(cues: DataFrame, recordings: DataFrame, block_seconds: int = 30, lex: Lexicon = ENGLISH) -> DataFrame:
    """The outline document as ordered lines: header, speakers, block transcript, moments skeleton."""
    n = cues.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_set(tr.named(F.col("speaker")))).alias("_who"))
    r = recordings.join(n, KEY, "left")
    info = _line(
        "Source: `", F.col("path"), "` · ", ck.clock(F.col("duration_seconds")), " long · ", F.coalesce("_n", F.lit(0)).cast("string"),
        f" caption cues · {block_seconds} s blocks",
    )
    who = F.when(F.size("_who") > 0, _line("Speakers: ", F.array_join("_who", ", ")))
    head = F.array_compact(F.array(_line("# ", F.col("title"), " — outline"), F.lit(""), info, who, F.lit("\n## Transcript\n")))
    out = r.select(KEY, F.lit(0).alias("part"), F.posexplode(head).alias("ix", "line")).withColumn("ix", F.col("ix").cast("long"))
    blocks = tr.format_blocks(cues, block_seconds, lex)
    out = out.unionByName(blocks.select(KEY, F.lit(1).alias("part"), F.col("block").alias("ix"), _line(F.col("text"), "\n").alias("line")))
    bare = recordings.join(blocks.select(KEY).distinct(), KEY, "left_anti")
    out = out.unionByName(bare.select(KEY, F.lit(1).alias("part"), F.lit(0).cast("long").alias("ix"), F.lit("(no speech found)\n").alias("line")))
    tail = "## Moments skeleton\n\nPick the moments worth keeping and fill this list:\n\n```json\n" + SKELETON + "\n```\n"
    return out.unionByName(recordings.select(KEY, F.lit(2).alias("part"), F.lit(0).cast("long").alias("ix"), F.lit(tail).alias("line")))


@dataclass
class Reel:
    moments: DataFrame
    plans: DataFrame
    faults: DataFrame
    notes: DataFrame


def reel(
    cues: DataFrame, recordings: DataFrame, minutes: float = 4.0, words: DataFrame | None = None, silences: DataFrame | None = None,
    specs: DataFrame | None = None, proposals: DataFrame | None = None, settings: DataFrame | None = None,
    takeaways: DataFrame | None = None, preset: str = "internal", lex: Lexicon = ENGLISH, **cut_options,
) -> Reel:
    """Q4: moments (hand-picked, proposed, or by the heuristic), cut, and the plan of each recording's reel.

    ``recordings``: recording_id, path, duration_seconds, title, date. A recording whose proposals give fewer than two
    moments falls back to the heuristic.
    """
    annotated = cut_lineage(cuts.annotate_words(words)) if words is not None else None  # snapping and cutting read them
    if specs is not None:
        m = picks.moments_from_specs(specs, cues, words, lex, annotated)
    elif proposals is not None:
        ok = picks.validate_proposals(proposals, recordings)
        m = cut_lineage(picks.fit_moments(picks.moments_from_specs(ok.withColumn("lines", F.array().cast("array<string>")), cues, words, lex, annotated), minutes))
        enough = m.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= picks.MIN_MOMENTS).select(KEY)
        m = m.join(enough, KEY, "left_semi")
        rest = cut_lineage(cues.join(enough, KEY, "left_anti"))
        m = m.unionByName(picks.pick_moments(rest, minutes, preset, words, lex), allowMissingColumns=True)
    else:
        m = picks.pick_moments(cues, minutes, preset, words, lex)
    m, notes = picks.resolve_overlaps(cut_lineage(m), recordings)
    m = cut_lineage(m.join(recordings.select(KEY, F.col("duration_seconds").alias("_dur")), KEY).withColumnRenamed("moment_ix", "req_ix"))
    m = cuts.cut_moments(m, words, silences, duration=F.col("_dur"), annotated=annotated, fillers=words is not None and cut_options.pop("fillers", True), **cut_options)
    m = cut_lineage(m.withColumnRenamed("req_ix", "moment_ix").drop("_dur"))
    if takeaways is None:
        lessons = m.where(F.col("lesson") != "").groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("moment_ix", "lesson")))["lesson"].alias("_l"))
        titles = m.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("moment_ix", "title")))["title"].alias("_t"))
        best = picks.executive_summary(cues, lex=lex).withColumn("text", tx.tidy_sentence(F.col("text"), lex))
        best = best.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("sent_ix", "text")))["text"].alias("_s"))
        chosen = [F.col("_l")] + ([F.col("_t")] if specs is not None or proposals is not None else []) + [F.col("_s"), F.col("_t")]
        takeaways = titles.join(lessons, KEY, "left").join(best, KEY, "left").select(KEY, F.coalesce(*chosen).alias("takeaways"))
    # written before its runtime is read off it: otherwise each use of the plan would hold the whole plan as an expression
    plans = cut_lineage(build.plan_documents(build.build_reel_plan(m, recordings, takeaways, settings, preset)))
    plans = plans.withColumn("runtime", cards.plan_runtime(F.col("plan")))
    faults = validate.violations(plans.withColumnRenamed(KEY, "plan_id"))
    return Reel(m, plans, faults, notes)


def audit_plan(plans: DataFrame, samples: DataFrame, words: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Q5: levels at every cut edge of each recording's plan, and the counts per recording."""
    clips = plans.select(KEY, F.explode("plan.clips").alias("c"))
    segments = clips.select(KEY, F.col("c.id").alias("clip"), F.posexplode("c.segments").alias("segment", "s")).select(
        KEY, "clip", (F.col("segment") + 1).alias("segment"), F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end")
    )
    readings = signal.audit_edges(segments, samples, words, **options)
    return readings, signal.audit_report(readings)


def storyboard(plans: DataFrame, cues: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Q6: the scenes of each reel in order, with who talks in a clip and what they say."""
    scenes = cards.timeline(plans, KEY)
    spans = plans.select(KEY, F.posexplode("plan.clips").alias("clip_ix", "c")).select(
        KEY, "clip_ix", F.col("c.id").alias("clip_id"), F.posexplode("c.segments").alias("seg_ix", "s")
    ).select(KEY, "clip_ix", "clip_id", "seg_ix", F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"))
    talk = tr.talk_time(spans.drop("clip_id"), cues, words).join(spans.select(KEY, "clip_ix", "clip_id").distinct(), [KEY, "clip_ix"])
    return scenes.join(talk.select(KEY, "clip_id", "speakers", "quote"), [KEY, "clip_id"], "left")


redact_text, check_redaction, redact_screens = pii.redact_text, pii.check_and_patch, pii.redact_screens  # Q7, Q8


def validate_plans(docs: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """Q9: every fault of plan documents (plan_id, plan_json) and, when given, of moment specs (spec_id, record)."""
    out = validate.violations(docs).withColumn("plan_id", F.col("plan_id").cast("string"))
    if specs is None:
        return out
    return out.unionByName(validate.validate_story(specs).withColumnRenamed("spec_id", "plan_id").withColumn("plan_id", F.col("plan_id").cast("string")))
