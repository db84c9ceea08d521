"""Pixel boxes as ``struct<x,y,w,h>`` columns, and thumbnails as int arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MIN_BOX = 16


def box(x, y, w, h) -> Column:
    named = zip("xywh", (x, y, w, h))
    return F.struct(*[c.cast("int").alias(n) for n, c in named])


def _axis(lo: Column, size: Column, frame: Column, pad: Column) -> tuple[Column, Column]:
    """One axis: pad, grow to the minimum, clip to the frame, floor to even pixels."""
    a, b = lo - pad, lo + size + pad
    grow = F.greatest(MIN_BOX - (b - a), F.lit(0))
    half = F.floor(grow / 2)
    a, b = F.greatest(a - half, F.lit(0)), F.least(b + (grow - half), frame)
    return a - F.pmod(a, F.lit(2)), b - F.pmod(b, F.lit(2))


def clamp_box(b: Column, width: Column, height: Column, pad: Column | int = 0) -> Column:
    """The box to blur, or null when nothing of it is on screen."""
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    x, y, w, h = (F.rint(b[n].cast("double")).cast("int") for n in "xywh")
    x0, x1 = _axis(x, w, width, pad)
    y0, y1 = _axis(y, h, height, pad)
    seen = (w > 0) & (h > 0) & (x1 - x0 >= 2) & (y1 - y0 >= 2)
    return F.when(seen, box(x0, y0, x1 - x0, y1 - y0))


def box_union(a: Column, b: Column) -> Column:
    x0, y0 = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    x1 = F.greatest(a["x"] + a["w"], b["x"] + b["w"])
    y1 = F.greatest(a["y"] + a["h"], b["y"] + b["h"])
    return box(x0, y0, x1 - x0, y1 - y0)


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over the smaller box."""
    ix = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    iy = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    small = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when(small == 0, F.lit(0.0)).otherwise(ix * iy / small)


def box_hull(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Aggregate: the smallest box around all boxes of a group."""
    return box(F.min(x), F.min(y), F.max(x + w) - F.min(x), F.max(y + h) - F.min(y))


def _comparable(a: Column, b: Column) -> Column:
    return F.coalesce((F.size(a) > 0) & (F.size(a) == F.size(b)), F.lit(False))


def changed_share(a: Column, b: Column, delta: int = 12) -> Column:
    """Share of thumbnail positions that differ by more than ``delta``; 1 when unknown."""
    diff = F.zip_with(a, b, lambda p, q: F.abs(p - q))
    return F.when(_comparable(a, b), F.size(F.filter(diff, lambda d: d > delta)) / F.size(a)).otherwise(F.lit(1.0))


def max_diff(a: Column, b: Column) -> Column:
    """Largest difference of two thumbnails; 255 when unknown."""
    diff = F.zip_with(a, b, lambda p, q: F.abs(p - q))
    return F.when(_comparable(a, b), F.array_max(diff)).otherwise(F.lit(255)).cast("int")


def luhn(text: Column) -> Column:
    """13 to 19 digits whose checksum is right."""
    digits = F.reverse(F.split(F.regexp_replace(text, r"\D", ""), ""))
    digits = F.filter(digits, lambda d: d != "")

    def value(d: Column, k: Column) -> Column:
        v = d.cast("int")
        return F.when(k % 2 == 1, F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)).otherwise(v)

    total = F.aggregate(F.transform(digits, value), F.lit(0), lambda acc, v: acc + v)
    return F.size(digits).between(13, 19) & (total % 10 == 0)
