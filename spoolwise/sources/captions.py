"""SRT captions: a tolerant and a strict reader, and a writer. A file is parsed inside its row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import clock as ck
from ..operators.scans import KEY, by_index, scan, total
from . import files

STAMP = r"(\d+):(\d\d):(\d\d)[,.](\d{1,3})"
STRICT_STAMP = r"([0-9]{2,}):([0-9]{2}):([0-9]{2}),([0-9]{3})"
STRICT_TIMING = rf"^{STRICT_STAMP}\s+-->\s+{STRICT_STAMP}$"


def _seconds(stamp: Column, pattern: str = STAMP) -> Column:
    part = lambda n: F.regexp_extract(stamp, pattern, n)
    return (
        part(1).try_cast("long") * 3600 + part(2).try_cast("long") * 60 + part(3).try_cast("long")
        + F.rpad(part(4), 3, "0").try_cast("long") / F.lit(1000)
    )


def parse_srt(docs: DataFrame) -> DataFrame:
    """Cues of SRT text; whatever cannot be read is skipped."""

    def cue(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, r"\r?\n|\r"), lambda ln: F.trim(F.regexp_replace(ln, r"(?U)^\s+|\s+$", ""))), lambda ln: ln != "")
        marks = F.filter(F.transform(lines, lambda ln, k: F.when(F.contains(ln, F.lit("-->")), k)), lambda k: k.isNotNull())
        at = F.get(marks, F.lit(0))
        stamps = F.regexp_extract_all(F.get(lines, at), F.lit(STAMP), F.lit(0))
        body = F.slice(lines, at + 2, F.size(lines))
        head = F.get(body, F.lit(0))
        named = F.coalesce(head.rlike(r"^\((.*?)\)\s*$"), F.lit(False))
        said = F.filter(F.when(named, F.slice(body, F.lit(2), F.size(body))).otherwise(body), lambda ln: ln != "-")
        return F.struct(
            _seconds(F.get(stamps, F.lit(0))).alias("start"), _seconds(F.get(stamps, F.lit(1))).alias("end"),
            F.trim(F.array_join(said, " ")).alias("text"),
            F.when(named, F.nullif(F.trim(F.regexp_extract(head, r"^\((.*?)\)\s*$", 1)), F.lit(""))).alias("speaker"),
            (at.isNotNull() & (F.size(stamps) >= 2)).alias("ok"),
        )

    blocks = F.split(F.trim(F.col("text")), r"\r?\n\s*\r?\n")
    cues = F.filter(F.transform(blocks, cue), lambda c: c["ok"] & (c["text"] != "") & (c["end"] > c["start"]))
    return docs.select(KEY, F.posexplode(cues).alias("cue_ix", "c")).select(KEY, "cue_ix", "c.start", "c.end", "c.text", "c.speaker")


def read_srt(spark: SparkSession, paths: str | list[str], rid=files.path_id) -> DataFrame:
    return parse_srt(files.read_documents(spark, paths, rid))


def parse_srt_strict(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cues with their text as written, and the blocks that break the rules (1-based position and reason).

    A block that does not open a cue continues the one before it; one before the first cue is an error. What follows a
    rejected block without opening a cue is rejected with it.
    """
    text = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r", "\n")
    raw = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\n[ \t]*\n")
    blocks = F.filter(
        F.transform(raw, lambda b, k: F.struct((k + 1).alias("position"), F.split(b, "\n").alias("lines"))),
        lambda b: F.trim(F.array_join(b["lines"], "")) != "",
    )
    lines = lambda b: b["lines"]
    timing = lambda b: F.trim(F.coalesce(F.get(lines(b), F.lit(1)), F.lit("")))
    indexed = lambda b: F.trim(F.get(lines(b), F.lit(0))).rlike("^[0-9]+$")
    opens = lambda b: indexed(b) & timing(b).rlike(STRICT_TIMING)

    def group(b: Column, k: Column) -> Column:
        later = F.slice(F.col("_b"), k + 2, F.size("_b"))
        until = F.array_min(F.filter(F.transform(later, lambda x, n: F.when(opens(x), n)), lambda n: n.isNotNull()))
        more = F.when(opens(b), F.slice(later, F.lit(1), F.coalesce(until, F.size(later)))).otherwise(F.slice(later, F.lit(1), F.lit(0)))
        said = F.concat(F.slice(lines(b), F.lit(3), F.size(lines(b))), F.flatten(F.transform(more, lines)))
        own = F.array_join(F.slice(lines(b), F.lit(3), F.size(lines(b))), "\n")
        t = timing(b)
        num = lambda n: F.regexp_extract(t, STRICT_TIMING, n).try_cast("long")
        start = num(1) * 3600 + num(2) * 60 + num(3) + num(4) / F.lit(1000)
        end = num(5) * 3600 + num(6) * 60 + num(7) + num(8) / F.lit(1000)
        high = (num(2) >= 60) | (num(3) >= 60) | (num(6) >= 60) | (num(7) >= 60)
        error = (
            F.when((F.size(lines(b)) < 3) | ~indexed(b), "a block holds a number, a line of times and text")
            .when(~t.rlike(STRICT_TIMING), "the line of times is not of the form 00:00:00,000 --> 00:00:00,000")
            .when(high, "minutes or seconds of 60 or more")
            .when(end <= start, "it ends no later than it starts")
            .when(F.trim(F.regexp_replace(own, r"\s", "")) == "", "no text")
        )
        return F.struct(
            b["position"].alias("position"), start.alias("start"), end.alias("end"), F.array_join(said, "\n").alias("text"),
            error.alias("message"), (opens(b) | (k == 0) | (F.array_min(F.filter(F.transform(F.col("_b"), lambda x, n: F.when(opens(x), n)), lambda n: n.isNotNull())) > k)
             | ~F.exists("_b", opens)).alias("head"),
        )

    d = docs.select(KEY, blocks.alias("_b"))
    d = d.select(KEY, F.filter(F.transform("_b", group), lambda g: g["head"]).alias("_g"))
    good = F.filter("_g", lambda g: g["message"].isNull())
    cues = d.select(KEY, F.posexplode(good).alias("cue_ix", "g")).select(KEY, "cue_ix", "g.start", "g.end", "g.text")
    bad = d.select(KEY, F.explode(F.filter("_g", lambda g: g["message"].isNotNull())).alias("g"))
    return cues, bad.select(KEY, F.col("g.position").alias("record_ix"), "g.message")


def read_srt_strict(spark: SparkSession, paths: str | list[str], rid=files.path_id) -> tuple[DataFrame, DataFrame]:
    return parse_srt_strict(files.read_documents(spark, paths, rid))


def srt_blocks(cues: DataFrame, strict: bool = False) -> DataFrame:
    """S3: numbered SRT blocks in order (one ``line`` row per cue; a block ends with its blank line).

    ``strict`` leaves out cues that round to nothing and numbers the rest.
    """
    ms = lambda c: F.rint(F.col(c) * 1000).cast("long")
    c = cues.withColumns({"_a": ms("start"), "_b": ms("end")})
    if strict:
        c = scan(c.where(F.col("_b") > F.col("_a")), [KEY], ["cue_ix"], by_index("cue_ix"), _n=total(F.lit(1)))
    else:
        c = c.withColumn("_n", F.col("cue_ix") + 1)
    block = F.concat(
        F.col("_n").cast("string"), F.lit("\n"), ck.srt_time_ms(F.col("_a")), F.lit(" --> "), ck.srt_time_ms(F.col("_b")),
        F.lit("\n"), F.col("text"), F.lit("\n"),
    )
    return c.select(KEY, "cue_ix", block.alias("line"))


def write_srt(cues: DataFrame, path: str, strict: bool = False, mode: str = "errorifexists") -> None:
    files.write_lines(srt_blocks(cues, strict), path, ["cue_ix"], mode)


def resolve_captions(sidecar: DataFrame | None, transcribed: DataFrame | None, embedded: DataFrame | None, recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One caption source per recording, the first of sidecar, transcript, embedded; and recordings with none.

    Which source wins is one small row per recording, joined back, so no recording is gathered for it.
    """
    named = [(k, n, df) for k, (n, df) in enumerate((("srt", sidecar), ("transcribed", transcribed), ("embedded", embedded))) if df is not None]
    every = None
    for k, n, df in named:
        d = df.withColumns({"captions_kind": F.lit(n), "_p": F.lit(k)})
        every = d if every is None else every.unionByName(d)
    best = every.groupBy(KEY).agg(F.min("_p").alias("_p"))
    cues = every.join(best, [KEY, "_p"]).drop("_p")
    missing = recordings.select(KEY).join(best, KEY, "left_anti").withColumn("message", F.lit("no captions"))
    return cues, missing
