"""Cues, words, sentences, speakers and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock as ck, text as tx
from ..functions.lexicon import ENGLISH, TERMINAL, Lexicon
from .folds import ordered_fold
from .ranges import overlap_join
from .scans import CHUNK_ROWS, KEY, after, before, by_index, scan, total, with_neighbours

MAX_SENTENCE = 20.0
SENTENCE_GAP = 1.5


def named(c: Column) -> Column:
    """A speaker, with the empty string read as unknown."""
    return F.nullif(c, F.lit(""))


def seconds() -> Column:
    return F.col("end") - F.col("start")


# ------------------------------------------------------------------ words and sentences

def words_from_cues(cues: DataFrame) -> DataFrame:
    """Word times by character share of the cue; the cue edges stay the only safe cut points."""
    toks = F.filter(F.split("text", r"(?U)\s+"), lambda t: t != "")
    c = cues.where(F.col("end") > F.col("start")).withColumn("_t", toks).withColumn("_n", F.size("_t").cast("long"))
    c = scan(c.where("_n > 0"), [KEY], ["cue_ix"], by_index("cue_ix", 8192), _n_end=total(F.col("_n")))
    rows = c.select(
        KEY, "cue_ix", "start", "end", "speaker", (F.col("_n_end") - F.col("_n")).alias("_n0"),
        F.aggregate("_t", F.lit(0), lambda a, t: a + F.length(t) + 1).alias("_all"), F.posexplode("_t").alias("_pos", "_w"),
    )
    inside = Window.partitionBy(KEY, "cue_ix").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.length("_w") + 1).over(inside)
    share = lambda x: F.col("start") + seconds() * x / F.col("_all")
    return rows.select(
        KEY, (F.col("_n0") + F.col("_pos")).alias("word_ix"), share(upto - F.length("_w") - 1).alias("_a"),
        share(upto).alias("_b"), F.col("_w").alias("text"), "speaker", F.lit(False).alias("timed"),
        F.col("start").alias("cut_start"), F.col("end").alias("cut_end"),
    ).withColumnsRenamed({"_a": "start", "_b": "end"})


def _other_speaker(a: Column, b: Column) -> Column:
    """Both known and different."""
    return F.coalesce(named(a) != named(b), F.lit(False))


def sentence_spans(words: DataFrame) -> DataFrame:
    """Words grouped into sentences by punctuation, speaker, gaps and a 20 s limit; ``first_word`` orders them."""
    w = with_neighbours(words, "word_ix", prev=("end", "text", "speaker"))
    breaks = (
        F.col("_prev").isNull()
        | F.col("_prev.text").rlike(TERMINAL)
        | _other_speaker(F.col("_prev.speaker"), F.col("speaker"))
        | (F.col("start") - F.col("_prev.end") > SENTENCE_GAP)
    )
    w = scan(w.withColumn("_b", breaks.cast("long")).drop("_prev"), [KEY], ["word_ix"], by_index("word_ix"), _run=total(F.col("_b")))
    # only runs that can pass the limit at all need the ordered walk
    run = Window.partitionBy(KEY, "_run")
    w = w.withColumn("_long", F.max("end").over(run) - F.min("start").over(run) > MAX_SENTENCE)
    cols = [KEY, "_run", "word_ix", "start", "end", "text", "speaker", "cut_start", "cut_end"]
    walked = ordered_fold(
        w.where("_long").select(*cols), [KEY, "_run"], ["word_ix"], _limit_length,
        f"{KEY} long, _run long, word_ix long, start double, end double, text string, speaker string, "
        "cut_start double, cut_end double, _part long",
    )
    first, last = F.min_by(F.struct("start", "cut_start"), "word_ix"), F.max_by(F.struct("end", "cut_end", "speaker"), "word_ix")
    joined = [
        first.alias("f"), last.alias("l"), F.min("word_ix").alias("first_word"), F.max("word_ix").alias("last_word"),
        F.array_sort(F.collect_list(F.struct("word_ix", "text"))).alias("_t"),
    ]
    # a run is in one of the two; the short ones are joined where the window over runs has put them
    s = w.where("not _long").groupBy(KEY, "_run").agg(*joined).withColumn("_part", F.lit(0).cast("long"))
    s = s.unionByName(walked.groupBy(KEY, "_run", "_part").agg(*joined))
    return s.select(
        KEY, F.coalesce("f.cut_start", "f.start").alias("start"), F.coalesce("l.cut_end", "l.end").alias("end"),
        F.col("f.start").alias("first"), F.col("l.end").alias("last"), F.array_join("_t.text", " ").alias("text"),
        F.col("l.speaker").alias("speaker"), "first_word", "last_word",
    )


def _limit_length():
    """Walk a long run: a word whose end lies over the limit past the span's start opens the next span."""
    state = {"start": None, "part": 0}

    def step(rows: list[tuple] | None) -> list[tuple]:
        out = []
        for row in rows or []:
            start, end = row[3], row[4]  # recording, run and word come before them
            if state["start"] is None:
                state["start"] = start
            elif end - state["start"] > MAX_SENTENCE:
                state["start"], state["part"] = start, state["part"] + 1
            out.append((*row, state["part"]))
        return out

    return step


def fragments(text: Column, lex: Lexicon = ENGLISH) -> Column:
    """The sentences, or parts of one, that a cue's cleaned text holds."""
    return F.filter(F.transform(tx.split_sentences(tx.clean_text(text, lex)), lambda p: F.btrim(p, F.lit(" ,"))), lambda p: p != "")


def sentences(
    cues: DataFrame, lex: Lexicon = ENGLISH, keys: tuple[str, ...] = (KEY,), parts: Column | None = None, short: bool = False
) -> DataFrame:
    """Sentences rejoined across cues; each starts where the cue of its first fragment starts.

    ``keys`` may hold more than the recording (one moment's cues, say); with ``short`` each of their groups is known to be
    small, and stays in one piece. ``parts`` are the fragments of a cue, if they have been worked out before.
    """
    keys = list(keys)
    parts = fragments(F.col("text"), lex) if parts is None else parts
    p = cues.select(*keys, "cue_ix", "start", "speaker", F.posexplode(parts).alias("_pos", "_p"))
    p = p.withColumn("_ends", F.col("_p").rlike(tx.TERMINAL_MARK))
    order, chunk = ["cue_ix", "_pos"], by_index("cue_ix", CHUNK_ROWS // 4)
    w = Window.partitionBy(*keys).orderBy(*order)
    opens = F.col("_prev").isNull() | F.col("_prev._ends") | ~F.col("_prev.speaker").eqNullSafe(F.col("speaker"))
    if short:
        p = p.withColumn("_prev", F.lag(F.struct("_ends", "speaker")).over(w)).withColumn("_o", opens.cast("long")).drop("_prev")
        p = p.withColumn("sent_ix", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        p = scan(p, keys, order, chunk, _prev=before(F.struct("_ends", "speaker")))
        p = scan(p.withColumn("_o", opens.cast("long")).drop("_prev"), keys, order, chunk, sent_ix=total(F.col("_o")))
    at = F.struct("cue_ix", "_pos")
    s = p.groupBy(*keys, "sent_ix").agg(
        F.min_by(F.struct("start", "speaker"), at).alias("h"),
        F.max_by("_ends", at).alias("_ended"),
        F.array_sort(F.collect_list(F.struct("cue_ix", "_pos", "_p"))).alias("_t"),
    )
    joined = F.array_join("_t._p", " ")
    return s.select(
        *keys, (F.col("sent_ix") - 1).alias("sent_ix"), F.col("h.start").alias("start"),
        F.when(F.col("_ended"), joined).otherwise(F.concat(joined, F.lit("."))).alias("text"),
        F.col("h.speaker").alias("speaker"),
    )


# ------------------------------------------------------------------ speakers

def align_speakers(
    cues: DataFrame, utterances: DataFrame, offset: float = 0.0, window: float = 30.0, min_overlap: float = 0.5,
    lex: Lexicon = ENGLISH,
) -> DataFrame:
    """Unlabelled cues take the speaker of the nearest note line that shares their words."""
    todo = cues.where(named(F.col("speaker")).isNull()).select(
        KEY, "cue_ix", ((F.col("start") + F.col("end")) / 2).alias("_mid"), tx.content_set(F.col("text"), lex).alias("_ct")
    ).where(F.size("_ct") > 0)
    notes = utterances.select(
        KEY, "utt_ix", (F.col("time") - offset).alias("_at"), F.col("speaker").alias("_who"),
        tx.content_set(F.col("text"), lex).alias("_ut"),
    )
    pairs = overlap_join(
        todo, notes, (F.col("_mid") - window, F.col("_mid") + window), ("_at", "_at"), 2 * window,
        F.col("_at").between(F.col("_mid") - window, F.col("_mid") + window),
    )
    share = F.size(F.array_intersect("_ct", "_ut")) / F.size("_ct")
    near = F.struct(-(share - 0.005 * F.abs(F.col("_at") - F.col("_mid"))), F.col("_at"), F.col("utt_ix"))
    best = pairs.where(share >= min_overlap).groupBy(KEY, "cue_ix").agg(F.min_by("_who", near).alias("_who"))
    out = cues.join(best, [KEY, "cue_ix"], "left")
    return out.withColumn("speaker", F.coalesce(named(F.col("speaker")), F.col("_who"))).select(*cues.columns)


def fill_speakers(cues: DataFrame, reach: float = 10.0) -> DataFrame:
    """An unlabelled cue between two cues of one speaker at most ``reach`` apart is theirs.

    Equal to filling left to right as long as cue ends do not decrease inside an unlabelled run.
    """
    known = F.when(named(F.col("speaker")).isNotNull(), F.struct("speaker", "start", "end"))
    c = scan(cues, [KEY], ["cue_ix"], by_index("cue_ix"), _p=before(known), _n=after(known))
    same = (F.col("_p.speaker") == F.col("_n.speaker")) & (F.col("_n.start") - F.col("_p.end") <= reach)
    return c.withColumn(
        "speaker", F.coalesce(named(F.col("speaker")), F.when(same, F.col("_p.speaker")))
    ).select(*cues.columns)


def dominant_speaker(cues: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """A3: the speaker with most seconds; the one heard first on ties."""
    per = cues.where(named(F.col("speaker")).isNotNull()).groupBy(*keys, "speaker").agg(
        F.sum(seconds()).alias("_s"), F.min("cue_ix").alias("_first")
    )
    best = F.max_by("speaker", F.struct(F.round("_s", 9), -F.col("_first")))
    return per.groupBy(*keys).agg(best.alias("speaker"), F.max("_s").alias("seconds"))


def talk_time(spans: DataFrame, cues: DataFrame, words: DataFrame | None = None, width: float = 60.0) -> DataFrame:
    """Per clip, who talks (most seconds first) and what is said over its kept spans.

    ``spans``: recording_id, clip_ix, seg_ix, s_start, s_end.
    """
    keys = [KEY, "clip_ix"]
    c = cues.select(KEY, "cue_ix", F.col("start").alias("_a"), F.col("end").alias("_b"), "speaker", F.col("text").alias("_t"))
    met = overlap_join(
        spans, c, ("s_start", "s_end"), ("_a", "_b"), width, (F.col("_a") < F.col("s_end")) & (F.col("_b") > F.col("s_start"))
    )
    share = F.least("_b", "s_end") - F.greatest("_a", "s_start")
    talk = met.where(named(F.col("speaker")).isNotNull()).groupBy(*keys, "speaker").agg(
        F.sum(share).alias("_s"), F.min(F.struct("seg_ix", "cue_ix")).alias("_f")
    )
    talk = talk.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.round("_s", 9)).alias("n"), F.col("_f"), F.col("speaker"), F.col("_s")))).alias("_x")
    ).select(*keys, F.col("_x.speaker").alias("speakers"), F.col("_x._s").alias("talk_seconds"))
    if words is None:
        said = met.select(*keys, "seg_ix", F.col("cue_ix").cast("long").alias("_ix"), "_t")
    else:
        w = words.select(KEY, "word_ix", F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("text").alias("_t"))
        said = overlap_join(
            spans, w, ("s_start", "s_end"), ("_a", "_b"), width, (F.col("_a") < F.col("s_end")) & (F.col("_b") > F.col("s_start"))
        ).select(*keys, "seg_ix", F.col("word_ix").alias("_ix"), "_t")
    said = said.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seg_ix", "_ix", "_t"))).alias("_x"))
    all_words = F.filter(F.split(F.array_join("_x._t", " "), r"(?U)\s+"), lambda t: t != "")
    said = said.select(*keys, tx.quote(all_words).alias("quote"))
    out = spans.select(*keys).distinct().join(talk, keys, "left").join(said, keys, "left")
    none = F.array().cast("array<string>")
    return out.select(*keys, F.coalesce("speakers", none).alias("speakers"), "talk_seconds", F.coalesce("quote", F.lit("")).alias("quote"))


def classify(cues: DataFrame, keys: tuple[str, ...] = (KEY,), lex: Lexicon = ENGLISH) -> DataFrame:
    """Q&A, Decision, Demo, Lesson or nothing, per group of cues."""
    g = cues.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("cue_ix", "text")))["text"], " ").alias("_t"),
        F.count_distinct(named(F.col("speaker"))).alias("_n"),
    )
    t = F.col("_t")
    return g.select(*keys, label_of(t, F.col("_n"), lex).alias("label"))


def label_of(text: Column, speakers: Column, lex: Lexicon = ENGLISH) -> Column:
    return (
        F.when(F.contains(text, F.lit("?")) & (speakers >= 2), "Q&A")
        .when(text.rlike("(?iU)" + lex.decision_label), "Decision")
        .when(text.rlike("(?iU)" + lex.demo_label), "Demo")
        .when(tx.teachable(text, lex) >= 1.5, "Lesson")
    )


# ------------------------------------------------------------------ cue times

def shift_origin(cues: DataFrame, origin: str | float) -> DataFrame:
    """P25: put cue times on the media clock; ``origin`` is a column name or a number."""
    o = F.col(origin) if isinstance(origin, str) else F.lit(float(origin))
    return cues.where(F.col("end") > o).withColumns(
        {"start": F.greatest(F.lit(0.0), F.col("start") - o), "end": F.col("end") - o}
    )


def strip_annotations(cues: DataFrame) -> DataFrame:
    """P20: cue lines that carry no speech go, and cues left empty with them."""
    return cues.withColumn("text", tx.strip_annotation_lines(F.col("text"))).where(F.col("text") != "")


def retime(cues: DataFrame, segments: DataFrame, min_kept: float = 0.25, width: float = 60.0) -> DataFrame:
    """Cues of the kept segments on the output clock. ``segments``: recording_id, [clip_ix], seg_ix, s_start, s_end.

    Segments of one clip are few (at most 20 by contract), so their running offset is a plain window.
    """
    keys = [c for c in (KEY, "clip_ix") if c in segments.columns]
    w = Window.partitionBy(*keys).orderBy("seg_ix").rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("s_end") - F.col("s_start")
    segs = segments.withColumn("_off", F.sum(length).over(w) - length)
    met = overlap_join(
        cues, segs, ("start", "end"), ("s_start", "s_end"), width,
        (F.col("start") < F.col("s_end")) & (F.col("end") > F.col("s_start")),
    )
    a, b = F.greatest("start", "s_start"), F.least("end", "s_end")
    cut = (a > F.col("start")) | (b < F.col("end"))
    rel = lambda t: (t - F.col("start")) / seconds()
    out = met.where(~cut | ((b - a) / seconds() > min_kept)).withColumn(
        "_text", F.when(cut, tx.trim_words(F.col("text"), rel(a), rel(b))).otherwise(F.col("text"))
    ).where(~cut | (F.trim("_text") != ""))
    return out.select(
        *keys, "seg_ix", "cue_ix", (F.col("_off") + (a - F.col("s_start"))).alias("start"),
        (F.col("_off") + (b - F.col("s_start"))).alias("end"), F.col("_text").alias("text"),
    )


# ------------------------------------------------------------------ blocks

def with_block(cues: DataFrame, block_seconds: int = 30) -> DataFrame:
    """A1: the tumbling block a cue starts in."""
    return cues.withColumn("block", F.floor(F.col("start") / block_seconds))


def block_stats(cues: DataFrame, block_seconds: int = 30) -> DataFrame:
    return with_block(cues, block_seconds).groupBy(KEY, "block").agg(
        F.count(F.lit(1)).alias("cues"), F.sum(tx.token_count(F.col("text"))).cast("long").alias("words"),
        F.count_distinct("speaker").alias("speakers"),
    )


def format_blocks(cues: DataFrame, block_seconds: int = 30, lex: Lexicon = ENGLISH) -> DataFrame:
    """A2: ``[h:mm:ss] Name: text`` per block, one line per turn. A block holds 30 s of captions."""
    c = with_block(cues, block_seconds).select(
        KEY, "block", "cue_ix", "speaker", tx.clean_text(F.col("text"), lex).alias("t")
    ).where(F.col("t") != "")
    g = c.groupBy(KEY, "block").agg(F.array_sort(F.collect_list(F.struct("cue_ix", "speaker", "t"))).alias("x"))
    stamp = F.concat(F.lit("["), ck.clock(F.col("block") * block_seconds), F.lit("]"))
    pad = F.repeat(F.lit(" "), F.length(stamp))

    def line(c: Column, k: Column) -> Column:
        who = F.coalesce(F.concat(named(c["speaker"]), F.lit(": ")), F.lit(""))
        same = F.get(F.col("x"), k - 1)["speaker"].eqNullSafe(c["speaker"])
        return (
            F.when(k == 0, F.concat(stamp, F.lit(" "), who, c["t"]))
            .when(same, F.concat(F.lit(" "), c["t"]))
            .otherwise(F.concat(F.lit("\n"), pad, F.lit(" "), who, c["t"]))
        )

    return g.select(KEY, "block", F.array_join(F.transform("x", line), "").alias("text"))


def chunk_blocks(blocks: DataFrame, limit: int = 28000) -> DataFrame:
    """Pack blocks in order into chunks of at most ``limit`` characters; an oversized block stands alone."""

    def start():
        state = {"size": 0, "chunk": 0}

        def step(rows: list[tuple] | None) -> list[tuple]:
            out = []
            for rid, block, size in rows or []:
                size += 2
                if state["size"] and state["size"] + size > limit:
                    state["size"], state["chunk"] = 0, state["chunk"] + 1
                state["size"] += size
                out.append((rid, block, state["chunk"]))
            return out

        return step

    sizes = blocks.select(KEY, "block", F.length("text").alias("_len"))
    at = ordered_fold(sizes, [KEY], ["block"], start, f"{KEY} long, block long, chunk long")
    return blocks.join(at, [KEY, "block"])


def chunk_texts(chunked: DataFrame) -> DataFrame:
    """The chunk texts themselves; a chunk is bounded by the packing limit."""
    g = chunked.groupBy(KEY, "chunk").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("x"))
    return g.select(KEY, "chunk", F.array_join("x.text", "\n\n").alias("text"))


def top_topics(lines: DataFrame, k: int = 3, keys: tuple[str, ...] = (KEY,), lex: Lexicon = ENGLISH) -> DataFrame:
    """A4: content words longer than three letters that recur in at least two lines, by line count then word."""
    w = lines.select(*keys, F.explode(tx.content_set(F.col("text"), lex, 4)).alias("word"))
    n = w.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") >= 2)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("lines"), "word"))
    return n.withColumn("rank", rank).where(F.col("rank") <= k)


def best_sentence(
    cues: DataFrame, keys: tuple[str, ...] = (KEY,), lex: Lexicon = ENGLISH, parts: Column | None = None, short: bool = False
) -> DataFrame:
    """A5: the most substantive sentence of each group of cues, cleaned. ``parts`` and ``short`` as in ``sentences``."""
    s = sentences(cues, lex, keys, parts, short)
    order = F.struct(F.round(tx.score_sentence(F.col("text"), None, lex), 9), F.length("text"), -F.col("sent_ix"))
    return s.groupBy(*keys).agg(F.max_by("text", order).alias("_t")).select(*keys, tx.clean_text(F.col("_t"), lex).alias("text"))


def best_sentence_for_terms(texts: DataFrame, request: str, lex: Lexicon = ENGLISH) -> DataFrame:
    """J16 over a table with a ``text`` column."""
    return texts.withColumn("sentence", tx.best_sentence_for(F.col("text"), tx.keywords(F.lit(request), lex), lex=lex))
