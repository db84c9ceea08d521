"""Words, meeting notes, OCR output, redactions, moment specs, media facts and work manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import boxes as bx, clock as ck
from ..operators.scans import KEY
from . import files

field = files.field


# ------------------------------------------------------------------ words

def parse_words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Timed words from ``[{start, end, word}]``; bad rows are skipped, words without length are kept.

    Returns (words, files that are not a JSON list).
    """

    def word(item: Column) -> Column:
        text = F.coalesce(F.nullif(field(item, "word"), F.lit("")), field(item, "text"), F.lit(""))
        return F.struct(
            ck.to_number(field(item, "start")).alias("start"), ck.to_number(field(item, "end")).alias("end"),
            F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("text"),
        )

    d = docs.withColumn("_items", files.json_items(F.col("text")))
    good = F.filter(F.transform("_items", word), lambda w: (w["text"] != "") & (w["end"] >= w["start"]))
    ordered = F.array_sort(F.transform(good, lambda w, k: F.struct(w["start"].alias("start"), w["end"].alias("end"), k.alias("k"), w["text"].alias("text"))))
    words = d.select(KEY, F.posexplode(ordered).alias("word_ix", "w")).select(
        KEY, F.col("word_ix").cast("long").alias("word_ix"), "w.start", "w.end", "w.text", F.lit(None).cast("string").alias("speaker"),
        F.lit(True).alias("timed"), F.lit(None).cast("double").alias("cut_start"), F.lit(None).cast("double").alias("cut_end"),
    )
    return words, d.where(F.col("_items").isNull()).select(KEY, F.lit("the file is no list of word timings").alias("message"))


def read_words(spark: SparkSession, paths: str | list[str], rid=files.path_id) -> tuple[DataFrame, DataFrame]:
    return parse_words(files.read_documents(spark, paths, rid))


def write_words(words: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines of start, end and word, times at 3 places, a folder per recording."""
    out = words.select(KEY, "word_ix", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.col("text").alias("word"))
    out.repartition(KEY).sortWithinPartitions(KEY, "word_ix").drop("word_ix").write.mode(mode).partitionBy(KEY).json(path)


# ------------------------------------------------------------------ meeting notes

# The forms of a time line and of a spoken line in meeting notes.
ANCHOR = r"^\s*(\d{1,2}):(\d{2}):(\d{2})\s*$"
NOTE_LINE = r"^([A-Z][A-Za-z.'’\- ]{0,39}):\s+(\S.*)$"


def parse_notes(docs: DataFrame, chars_per_second: float = 15.0) -> DataFrame:
    """Note lines with times interpolated between clock lines by their share of characters."""
    lines = F.transform(F.split("text", r"\r\n|\n|\r"), lambda ln: F.trim(F.regexp_replace(ln, r"(?U)^\s+|\s+$", "")))
    is_anchor = lambda ln: ln.rlike(ANCHOR)
    num = lambda ln, n: F.regexp_extract(ln, ANCHOR, n).cast("long")

    def block(ln: Column, k: Column) -> Column:
        later = F.slice(F.col("_l"), k + 2, F.size("_l"))
        until = F.array_min(F.filter(F.transform(later, lambda x, n: F.when(is_anchor(x), n)), lambda n: n.isNotNull()))
        said = F.transform(
            F.filter(F.slice(later, F.lit(1), F.coalesce(until, F.size(later))), lambda x: x.rlike(NOTE_LINE)),
            lambda x: F.struct(F.trim(F.regexp_extract(x, NOTE_LINE, 1)).alias("speaker"), F.trim(F.regexp_extract(x, NOTE_LINE, 2)).alias("text")),
        )
        clock = lambda x: num(x, 1) * 3600 + num(x, 2) * 60 + num(x, 3)
        return F.when(is_anchor(ln), F.struct(clock(ln).alias("t"), clock(F.get(later, until)).alias("next"), said.alias("said")))

    def timed(b: Column) -> Column:
        chars = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x["text"]))
        all_ = F.greatest(chars(b["said"]), F.lit(1))
        span = F.greatest(F.coalesce((b["next"] - b["t"]).cast("double"), all_ / F.lit(chars_per_second)), F.lit(0.0))
        return F.transform(
            b["said"],
            lambda x, k: F.struct((b["t"] + span * chars(F.slice(b["said"], F.lit(1), k)) / all_).alias("time"), x["speaker"].alias("speaker"), x["text"].alias("text")),
        )

    d = docs.select(KEY, lines.alias("_l"))
    blocks = F.array_compact(F.transform("_l", block))
    return d.select(KEY, F.posexplode(F.flatten(F.transform(blocks, timed))).alias("utt_ix", "u")).select(
        KEY, "utt_ix", "u.time", "u.speaker", "u.text"
    )


def read_notes(spark: SparkSession, paths: str | list[str], rid=files.path_id) -> DataFrame:
    return parse_notes(files.read_documents(spark, paths, rid))


# ------------------------------------------------------------------ OCR

TSV = (
    "level string, page_num string, block_num string, par_num string, line_num string, word_num string, "
    "`left` string, top string, width string, height string, conf string, text string"
)


def read_ocr_tsv(spark: SparkSession, paths: str | list[str], scale: float = 1.0, rid=files.path_id, frame_ts=None) -> DataFrame:
    """Word rows (level 5) of OCR output, boxes divided by the upscale. ``frame_ts`` reads the time from the path."""
    raw = spark.read.csv(paths, schema=TSV, sep="\t", quote="", header=True).withColumn("_path", F.col("_metadata.file_path"))
    when = frame_ts(F.col("_path")) if frame_ts else F.regexp_extract("_path", r"(\d+(?:\.\d+)?)[^/\d]*$", 1).try_cast("double")
    px = lambda c: F.rint(F.col(c).try_cast("int") / F.lit(float(scale))).cast("int")
    whole = lambda c: F.col(c).try_cast("int")
    d = raw.where(F.col("level") == "5").select(
        rid(F.col("_path")).alias(KEY), when.alias("frame_ts"), whole("block_num").alias("block"), whole("par_num").alias("par"),
        whole("line_num").alias("line"), whole("word_num").alias("word_ix"), F.trim("text").alias("text"), px("left").alias("x"),
        px("top").alias("y"), px("width").alias("w"), px("height").alias("h"), F.coalesce(ck.to_number(F.col("conf")), F.lit(-1.0)).alias("conf"),
    )
    return d.where((F.col("text") != "") & F.least("block", "par", "line", "x", "y", "w", "h").isNotNull()).dropna(subset=["block", "par", "line", "x", "y", "w", "h"])


# ------------------------------------------------------------------ redactions

def parse_redactions(docs: DataFrame, width: int, height: int, duration: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Strict records ``{start, end, box, why}`` on a frame; (redactions, rejects by 1-based record)."""
    d = docs.select(KEY, F.posexplode_outer(files.json_items(F.col("text"))).alias("_k", "_r"))
    r = F.col("_r")
    nums = F.from_json(field(r, "box"), "array<double>")
    start, end = ck.parse_clock(field(r, "start")), ck.parse_clock(field(r, "end"))
    raw = F.struct(*[F.get(nums, F.lit(k)).alias(n) for k, n in enumerate("xywh")])
    d = d.withColumns({"start": start, "end": end, "_n": nums, "_box": bx.clamp_box(raw, F.lit(width), F.lit(height))})
    message = (
        F.when(r.isNull(), "the file is no list of redaction records")
        .when(F.col("start").isNull() | F.col("end").isNull() | field(r, "box").isNull(), "start, end or box is missing or unreadable")
        .when(F.coalesce(F.size("_n") != 4, F.lit(True)) | F.exists("_n", lambda v: v.isNull()), "a box holds four numbers: left, top, width, height")
        .when(F.col("end") <= F.col("start"), "it ends no later than it starts")
        .when(F.col("_box").isNull(), F.format_string(f"nothing of the box is inside {width} x {height} pixels"))
    )
    d = d.withColumn("message", message)
    if duration is not None:
        d = d.withColumns({"start": F.greatest(F.lit(0.0), "start"), "end": F.least(F.lit(duration), "end")})
    good = d.where(F.col("message").isNull()).select(
        KEY, "start", "end", "_box.x", "_box.y", "_box.w", "_box.h", F.trim(F.coalesce(field(r, "why"), F.lit(""))).alias("why")
    )
    return good, d.where(F.col("message").isNotNull()).select(KEY, (F.coalesce("_k", F.lit(-1)) + 1).alias("record_ix"), "message")


def read_redactions(spark, paths, width: int, height: int, duration: float | None = None, rid=files.path_id) -> tuple[DataFrame, DataFrame]:
    return parse_redactions(files.read_documents(spark, paths, rid), width, height, duration)


def write_redactions(redactions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, times at 2 places, a folder per recording."""
    out = redactions.select(KEY, F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), F.array("x", "y", "w", "h").alias("box"), "why")
    out.repartition(KEY).sortWithinPartitions(KEY, "start").write.mode(mode).partitionBy(KEY).json(path)


# ------------------------------------------------------------------ moment specs

SPEC_TEXT = ("title", "takeaway", "why", "lesson", "context")
CARDS_IN = "array<struct<title:string,lines:string,seconds:double,image:string,qr:string>>"
OVERLAYS_IN = "array<struct<start:string,end:string,text:string,position:string>>"
LAYOUT_IN = "struct<kind:string,screen:array<int>,speaker:array<int>,corner:string>"


def _lines(raw: Column) -> Column:
    """One line or a list of lines."""
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(F.coalesce(raw, F.lit("")) != "", F.array(raw)).otherwise(F.array().cast("array<string>"))


def _story(r: Column) -> dict[str, Column]:
    """Cards, overlays, layout and picture of a moment; ``validate_story`` says what is wrong with them."""
    pictured = lambda c: F.coalesce(c["image"], c["qr"]).isNotNull()
    cards = F.transform(F.from_json(field(r, "cards"), CARDS_IN), lambda c: F.struct(
        c["title"].alias("title"), _lines(c["lines"]).alias("lines"), F.coalesce(c["seconds"], F.when(pictured(c), 4.0).otherwise(3.0)).alias("seconds"),
        c["image"].alias("image"), c["qr"].alias("qr")))
    overlays = F.transform(F.from_json(field(r, "overlays"), OVERLAYS_IN), lambda o: F.struct(
        F.round(ck.parse_clock(o["start"]), 3).alias("start"), F.round(ck.parse_clock(o["end"]), 3).alias("end"), o["text"].alias("text"),
        F.coalesce(o["position"], F.lit("top")).alias("position")))
    own = F.from_json(F.when(field(r, "layout").startswith("{"), field(r, "layout")), LAYOUT_IN)
    layout = F.when(F.coalesce(own["kind"], F.lit("pip")) == "pip", F.struct(
        F.lit("pip").alias("kind"), own["screen"].alias("screen"), own["speaker"].alias("speaker"), F.coalesce(own["corner"], F.lit("bottom-right")).alias("corner")))
    text = lambda n: F.nullif(field(r, n), F.lit(""))
    return {"cards": cards, "overlays": overlays, "layout": F.when(own.isNotNull(), layout), "image": text("image"), "qr": text("qr")}


def parse_moment_specs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hand-picked moments; ``lines`` may be one string. (moments, rejects by 1-based record)."""
    d = docs.select(KEY, F.posexplode_outer(files.json_items(F.col("text"))).alias("_k", "_r"))
    r = F.col("_r")
    lines = _lines(field(r, "lines"))
    d = d.withColumns({"start": ck.parse_clock(field(r, "start")), "end": ck.parse_clock(field(r, "end")), "lines": F.slice(lines, 1, 4)})
    d = d.withColumns({n: F.nullif(field(r, n), F.lit("")) for n in SPEC_TEXT})
    d = d.withColumn("score", F.coalesce(ck.to_number(field(r, "score")), F.lit(0.0)))
    message = (
        F.when(r.isNull(), "the file is no list of moments")
        .when(F.col("start").isNull() | F.col("end").isNull(), "start or end is missing or unreadable")
        .when(F.col("end") <= F.col("start"), "it ends no later than it starts")
    )
    d = d.withColumn("message", message)
    good = d.where(F.col("message").isNull()).select(
        KEY, F.col("_k").alias("req_ix"), "start", "end", "lines", "score", *SPEC_TEXT, *[c.alias(n) for n, c in _story(r).items()], r.alias("record"))
    return good, d.where(F.col("message").isNotNull()).select(KEY, (F.coalesce("_k", F.lit(-1)) + 1).alias("record_ix"), "message")


def read_moment_specs(spark, paths, rid=files.path_id) -> tuple[DataFrame, DataFrame]:
    return parse_moment_specs(files.read_documents(spark, paths, rid))


def moment_specs_json(moments: DataFrame) -> DataFrame:
    """Moments as records the reader takes back; lesson and context only where there is one."""
    record = F.to_json(F.struct(
        F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "title", "takeaway", "lines", "why",
        F.nullif("lesson", F.lit("")).alias("lesson"), F.nullif("context", F.lit("")).alias("context"),
    ))
    return moments.select(KEY, "moment_ix", record.alias("record"))


def write_moment_specs(moments: DataFrame, path: str, mode: str = "errorifexists") -> None:
    files.write_lines(moment_specs_json(moments).withColumnRenamed("record", "line"), path, ["moment_ix"], mode)


# ------------------------------------------------------------------ media facts, manifests

PROBE = "struct<format:struct<duration:string>,streams:array<struct<codec_type:string>>>"


def media_facts(probes: DataFrame, text: str = "probe_json") -> tuple[DataFrame, DataFrame]:
    """Duration, streams and the first subtitle stream from probe output; (recordings, rejects)."""
    p = probes.withColumn("_p", F.from_json(text, PROBE))
    types = F.coalesce(F.transform("_p.streams", lambda s: s["codec_type"]), F.array().cast("array<string>"))
    duration = F.coalesce(ck.to_number(F.col("_p.format.duration")), F.lit(0.0))
    p = p.withColumns({
        "duration_seconds": duration, "has_video": F.array_contains(types, "video"), "has_audio": F.array_contains(types, "audio"),
        "subtitle_stream_index": F.when(F.array_contains(types, "subtitle"), F.lit(0)),
    }).drop("_p")
    ok = F.col("duration_seconds") > 0
    return p.where(ok).drop(text), p.where(~ok).select(KEY, F.lit("no duration in the probe output").alias("message"))


def incremental_filter(inputs: DataFrame, manifest: DataFrame, parts: list[str], version: int = 3) -> DataFrame:
    """Inputs whose fingerprint is not in the manifest yet, with their ``fingerprint``."""
    tag = ck.fingerprint(F.lit(version).alias("version"), *[F.col(p) for p in parts])
    # a fingerprint that a manifest holds often is met once
    return inputs.withColumn("fingerprint", tag).join(manifest.select("fingerprint").distinct(), "fingerprint", "left_anti")
