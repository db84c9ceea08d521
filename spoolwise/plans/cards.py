"""Cards, runtime and playback order of plans. A plan is bounded (50 clips), so it is worked on inside its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock as ck, text as tx
from ..functions.let import let
from ..functions.lexicon import ENGLISH, Lexicon
from .schema import CARD, PLAN, PRESET_BOUNDS

TITLE_LIMIT, LINE_LIMIT, LESSON_LIMIT, CONTEXT_LIMIT, TAKEAWAY_LIMIT = 80, 120, 80, 120, 200
CARD_SECONDS, MAX_LINES = 3.0, 4
OVERLAPPING = ("dissolve", "module")


def parsed(docs: DataFrame, text: str = "plan_json") -> DataFrame:
    """Plan documents plus the typed ``plan``; the raw text stays for validation."""
    return docs.withColumn("plan", F.from_json(text, PLAN))


def card(title: Column, lines: Column, seconds: Column, image: Column | None = None, qr: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        title.alias("title"), lines.alias("lines"), seconds.cast("double").alias("seconds"),
        (image if image is not None else null).alias("image"), (qr if qr is not None else null).alias("qr"),
    )


def _filled(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")


def topics(lines: Column, k: int = 3, lex: Lexicon = ENGLISH) -> Column:
    """A4 for the few lines of a card: words in at least two lines, most lines first, then by word."""
    counted = lambda words: F.transform(
        F.array_distinct(words), lambda w: F.struct((-F.size(F.filter(words, lambda v: v == w))).alias("n"), w.alias("w"))
    )
    # each line is read once, not again for every word found in it
    ranked = F.array_sort(let(F.flatten(F.transform(lines, lambda ln: tx.content_set(ln, lex, 4))), counted))
    return F.transform(F.slice(F.filter(ranked, lambda r: r["n"] <= -2), 1, k), lambda r: r["w"])


def opening_card(lessons: Column, title_hint: Column, lex: Lexicon = ENGLISH) -> Column:
    """One line per lesson; beyond four a summary line and the first three. Null without lessons."""
    clipped = F.transform(_filled(lessons), lambda x: tx.clip_text(x, LINE_LIMIT, lex))
    hint = F.coalesce(title_hint, F.lit(""))

    def made(lines: Column) -> Column:
        n = F.size(lines).cast("string")
        summary = let(topics(lines, 3, lex), lambda about: (
            F.when(F.size(about) > 0, F.concat(n, F.lit(" moments on "), F.array_join(about, ", ")))
            .when(hint != "", F.concat(n, F.lit(" moments from "), hint)).otherwise(F.concat(n, F.lit(" moments")))
        ))
        shown = F.when(
            F.size(lines) > MAX_LINES, F.concat(F.array(tx.clip_text(summary, LINE_LIMIT, lex)), F.slice(lines, 1, MAX_LINES - 1))
        ).otherwise(lines)
        return F.when(F.size(lines) > 0, let(shown, lambda x: card(F.lit("What you'll learn"), x, ck.card_seconds(x))))

    return let(clipped, made)


def closing_cards(takeaways: Column, max_cards: int | Column = 2, lex: Lexicon = ENGLISH) -> Column:
    """Takeaways, four lines to a card."""
    limit = max_cards if isinstance(max_cards, Column) else F.lit(max_cards)
    filled = F.filter(F.transform(_filled(takeaways), lambda x: tx.clip_text(x, LINE_LIMIT, lex)), lambda x: x != "")
    none = F.array().cast(f"array<{CARD}>")

    def dealt(lines: Column) -> Column:
        cards = F.ceil(F.size(lines) / MAX_LINES).cast("int")

        def nth(k: Column) -> Column:
            part = F.slice(lines, k * MAX_LINES + 1, F.lit(MAX_LINES))
            title = F.when(k == 0, F.lit("Takeaways")).otherwise(F.lit("Takeaways (continued)"))
            return card(title, part, ck.card_seconds(part))

        return F.when(cards > 0, F.transform(F.sequence(F.lit(0), cards - 1), nth)).otherwise(none)

    return let(F.slice(filled, F.lit(1), MAX_LINES * limit), dealt)


def outro_card(summary_name: str = "summary.md") -> Column:
    lines = F.array(F.lit(f"Full transcript and takeaways in {summary_name}"))
    return card(F.lit("That's the session"), lines, ck.card_seconds(lines))


def moment_card(
    title: Column, lines: Column, why: Column, lesson: Column, context: Column, image: Column | None = None,
    qr: Column | None = None, lex: Lexicon = ENGLISH,
) -> Column:
    """A moment's chapter card; the lesson is the title when there is one, with the context above the rest."""
    body = F.when(F.size(lines) > 0, lines).when(F.coalesce(why, F.lit("")) != "", F.array(why)).otherwise(F.array().cast("array<string>"))
    taught = F.coalesce(lesson, F.lit("")) != ""
    body = F.when(taught, F.concat(F.array(context), body)).otherwise(body)
    shown = F.transform(F.filter(body, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: tx.clip_text(x, LINE_LIMIT, lex))
    shown = F.slice(F.filter(shown, lambda x: x != ""), 1, MAX_LINES)
    seconds = F.lit(CARD_SECONDS)
    if image is not None or qr is not None:
        seconds = F.when(F.coalesce(*[c for c in (image, qr) if c is not None]).isNotNull(), 4.0).otherwise(CARD_SECONDS)
    return card(tx.clip_text(F.when(taught, lesson).otherwise(title), TITLE_LIMIT, lex), shown, seconds, image, qr)


# ------------------------------------------------------------------ runtime and timeline

def _seconds(c: Column) -> Column:
    return F.coalesce(c["seconds"], F.lit(CARD_SECONDS))


def kept_seconds(clip: Column) -> Column:
    return F.aggregate(clip["segments"], F.lit(0.0), lambda a, s: a + (s["end"] - s["start"]))


def _list(value: Column, kind: str) -> Column:
    return F.coalesce(value, F.array().cast(f"array<{kind}>"))


def plan_runtime(plan: Column) -> Column:
    """Seconds on screen: every card the plan holds and every kept second."""
    reel = plan["output"]["reel"]
    one = lambda c: F.coalesce(F.when(c.isNotNull(), _seconds(c)), F.lit(0.0))
    many = lambda xs: F.aggregate(_list(xs, CARD), F.lit(0.0), lambda a, c: a + _seconds(c))
    clips = F.aggregate(
        plan["clips"], F.lit(0.0), lambda a, c: a + many(c["cards"]) + one(c["card"]) + kept_seconds(c)
    )
    return one(reel["intro"]) + one(reel["outro"]) + many(reel["opening"]) + many(reel["closing"]) + clips


ITEM = "struct<kind:string,role:string,title:string,seconds:double,clip_id:string>"


def items(plan: Column) -> Column:
    """Cards and clips in playback order. The last card before a clip is its chapter card unless cards are off."""
    reel = plan["output"]["reel"]
    mode = F.coalesce(reel["chapter_cards"], F.lit("auto"))
    null = F.lit(None).cast("string")

    def shown(c: Column, role: Column | str) -> Column:
        r = role if isinstance(role, Column) else F.lit(role)
        return F.struct(F.lit("card").alias("kind"), r.alias("role"), c["title"].alias("title"), _seconds(c).alias("seconds"), null.alias("clip_id"))

    one = lambda c, role: F.when(c.isNotNull(), F.array(shown(c, role))).otherwise(F.array().cast(f"array<{ITEM}>"))
    many = lambda xs, role: F.transform(_list(xs, CARD), lambda c: shown(c, role))

    def clip_items(clip: Column) -> Column:
        none = F.array().cast("array<string>")
        made = card(clip["takeaway"], none, F.lit(CARD_SECONDS))
        own = F.when(clip["card"].isNotNull(), clip["card"]).when(mode == "all", made)
        before = F.concat(
            _list(clip["cards"], CARD),
            F.when(own.isNotNull() & (mode != "none"), F.array(own)).otherwise(F.array().cast(f"array<{CARD}>")),
        )
        cards = F.transform(
            before, lambda c, k: shown(c, F.when((k == F.size(before) - 1) & (mode != "none"), F.lit("chapter")).otherwise(F.lit("section")))
        )
        me = F.struct(
            F.lit("clip").alias("kind"), F.lit("clip").alias("role"), clip["takeaway"].alias("title"),
            kept_seconds(clip).alias("seconds"), clip["id"].alias("clip_id"),
        )
        return F.concat(cards, F.array(me))

    return F.concat(
        one(reel["intro"], "intro"), many(reel["opening"], "opening"), F.flatten(F.transform(plan["clips"], clip_items)),
        many(reel["closing"], "closing"), one(reel["outro"], "outro"),
    )


def effective_transition(kind: Column, seconds: Column, durations: Column) -> Column:
    """The longest transition all segments can afford, 0 when there is nothing to join."""
    n = F.size(durations)
    halves = F.transform(durations, lambda d, k: F.when((k == 0) | (k == n - 1), d).otherwise(d / 2))
    limit = F.array_min(F.when(kind.isin(*OVERLAPPING), halves).otherwise(durations))
    return F.when(kind.isNull() | (kind == "cut") | (n < 2), F.lit(0.0)).otherwise(F.least(seconds, limit))


def timeline(plans: DataFrame, key: str = "plan_id") -> DataFrame:
    """One row per card or clip with its start on the reel; a dissolve overlaps neighbours."""
    t = F.col("plan.output.reel.transition")
    d = plans.select(key, items(F.col("plan")).alias("_i"), t["kind"].alias("_kind"), F.coalesce(t["seconds"], F.lit(0.4)).alias("_s"))
    lengths = F.transform("_i", lambda x: x["seconds"])
    overlap = F.when(F.col("_kind").isin(*OVERLAPPING), effective_transition(F.col("_kind"), F.col("_s"), lengths)).otherwise(0.0)
    d = d.select(key, "_kind", overlap.alias("_o"), F.size("_i").alias("_n"), F.posexplode("_i").alias("item_ix", "x"))
    w = Window.partitionBy(key).orderBy("item_ix").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("x.seconds") - F.col("_o")).over(w), F.lit(0.0))
    last = F.col("item_ix") == F.col("_n") - 1
    return d.select(
        key, "item_ix", "x.kind", "x.role", "x.title", start.alias("start"), "x.seconds", "x.clip_id",
        F.when(last, "end").otherwise(F.coalesce("_kind", F.lit("cut"))).alias("transition"),
    )


def card_runs(plans: DataFrame, fps_num: int, fps_den: int = 1, key: str = "plan_id") -> DataFrame:
    """Runs of consecutive cards in whole frames: first frame, frames, and where in the reel the run lies."""
    t = F.col("plan.output.reel.transition")
    d = plans.select(key, items(F.col("plan")).alias("_i"), t["kind"].alias("_kind"), F.coalesce(t["seconds"], F.lit(0.4)).alias("_s"))
    frames = F.transform("_i", lambda x: ck.frame_count(x["seconds"], fps_num, fps_den))
    d = d.withColumns({"_f": frames, "_n": F.size("_i")})
    room = F.transform("_f", lambda f, k: F.when((k == 0) | (k == F.col("_n") - 1), f - 1).otherwise(F.floor((f - 1) / 2)))
    x = F.rint(F.col("_s") * 1_000_000).cast("long") * fps_num
    q = F.floor(x / F.lit(1_000_000 * fps_den)).cast("long")
    twice = 2 * (x - q * 1_000_000 * fps_den)
    wanted = q + F.when((twice > 1_000_000 * fps_den) | ((twice == 1_000_000 * fps_den) & (q % 2 == 1)), 1).otherwise(0)
    overlap = F.when(F.coalesce(F.col("_kind").isin(*OVERLAPPING), F.lit(False)) & (F.col("_n") >= 2), F.greatest(F.lit(0), F.least(wanted, F.array_min(room)))).otherwise(F.lit(0))
    d = d.select(key, "_n", overlap.cast("long").alias("_o"), F.posexplode(F.arrays_zip(F.transform("_i", lambda y: y["kind"] == "card").alias("card"), F.col("_f").alias("f"))).alias("ix", "x"))
    w = Window.partitionBy(key).orderBy("ix")
    at = F.coalesce(F.sum(F.col("x.f") - F.col("_o")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cards = d.withColumns({"_at": at, "_c": F.sum(F.when(F.col("x.card"), 0).otherwise(1)).over(w)}).where("x.card")
    g = cards.groupBy(key, "_c", "_n").agg(
        F.min("_at").alias("start_frame"), F.max_by(F.col("_at") + F.col("x.f"), "ix").alias("_end"), F.min("ix").alias("_a"), F.max("ix").alias("_b")
    )
    position = F.when(F.col("_a") == 0, "first").when(F.col("_b") == F.col("_n") - 1, "last").otherwise("middle")
    run = F.row_number().over(Window.partitionBy(key).orderBy("_a")) - 1
    return g.select(key, run.alias("run_ix"), "start_frame", (F.col("_end") - F.col("start_frame")).alias("frames"), position.alias("position"))


def preset_bounds_check(plans: DataFrame, key: str = "plan_id") -> DataFrame:
    """Clips whose kept seconds fall outside the bounds of the plan's preset."""
    low, high = (F.create_map(*[F.lit(x) for p, b in PRESET_BOUNDS.items() for x in (p, float(b[n]))]) for n in (0, 1))
    preset = F.coalesce(F.col("plan.output.preset"), F.lit("internal"))
    d = plans.select(key, preset.alias("preset"), F.explode("plan.clips").alias("c"))
    d = d.select(key, F.col("c.id").alias("clip_id"), "preset", kept_seconds(F.col("c")).alias("seconds"))
    return d.where(~F.col("seconds").between(F.element_at(low, F.col("preset")), F.element_at(high, F.col("preset"))))
