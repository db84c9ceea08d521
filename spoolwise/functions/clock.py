"""Clocks, timestamps, slugs and small arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def to_number(s: Column) -> Column:
    """A double, or null when the text is not one."""
    return F.when(s.rlike(NUMBER), F.trim(s).try_cast("double"))


def parse_clock(s: Column) -> Column:
    """seconds from ``h:mm:ss(.f)``, ``mm:ss`` or ``s`` with an optional sign; null otherwise."""
    s = F.trim(s.cast("string"))
    parts = F.split(F.ltrim(s, F.lit("+-")), ":", -1)
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + to_number(p))
    return F.when(F.size(parts) <= 3, F.when(F.startswith(s, F.lit("-")), -total).otherwise(total))


def _hms(whole: Column) -> tuple[Column, Column, Column]:
    return F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60


def clock(t: Column) -> Column:
    """always ``h:mm:ss``."""
    h, m, s = _hms(F.greatest(t.cast("long"), F.lit(0)))
    return F.format_string("%d:%02d:%02d", h, m, s)


def ts(t: Column) -> Column:
    """``m:ss``, or ``h:mm:ss`` from one hour on."""
    h, m, s = _hms(t.cast("long"))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def hms_tenths(t: Column) -> Column:
    """``h:mm:ss.s``."""
    t = F.greatest(t, F.lit(0.0))
    h, m, s = _hms(t.cast("long"))
    return F.format_string("%d:%02d:%04.1f", h, m, s + (t - t.cast("long")))


def srt_time(t: Column) -> Column:
    """``HH:MM:SS,mmm`` of a time in seconds."""
    return srt_time_ms(F.rint(t * 1000).cast("long"))


def srt_time_ms(ms: Column) -> Column:
    h, m, s = _hms(F.floor(ms / 1000))
    return F.format_string("%02d:%02d:%02d,%03d", h, m, s, ms % 1000)


def slug(text: Column, limit: int = 40) -> Column:
    """lower-case words joined by hyphens."""
    s = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.rtrim(F.left(s, F.lit(limit)), F.lit("-")), F.lit("")), F.lit("clip"))


def target_band(minutes: Column, tolerance: float = 0.20) -> Column:
    """(low, target, high) seconds."""
    t = minutes * 60.0
    return F.struct((t * (1 - tolerance)).alias("low"), t.alias("target"), (t * (1 + tolerance)).alias("high"))


def frame_count(seconds: Column, fps_num: int, fps_den: int = 1) -> Column:
    """whole frames, at least one, halves to even; integer arithmetic on microseconds."""
    x = F.rint(seconds * 1_000_000).cast("long") * fps_num
    d = 1_000_000 * fps_den
    q = F.floor(x / F.lit(d)).cast("long")
    twice = 2 * (x - q * d)
    return F.greatest(F.lit(1), q + F.when((twice > d) | ((twice == d) & (q % 2 == 1)), 1).otherwise(0)).cast("long")


def card_seconds(lines: Column) -> Column:
    """reading time of a card."""
    return F.least(F.lit(8.0), 3.0 + 1.5 * F.greatest(F.size(lines) - 1, F.lit(0)))


def fingerprint(*parts: Column) -> Column:
    """16 hex digits that identify one set of inputs."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 16)
