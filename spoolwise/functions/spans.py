"""Interval algebra inside one row: arrays of ``struct<a,b>``, for groups that are small by nature (one moment)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .let import let

EPS = 1e-6
SPAN_ARRAY = "array<struct<a:double,b:double>>"


def span(a: Column, b: Column) -> Column:
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))


def none() -> Column:
    return F.array().cast(SPAN_ARRAY)


def merged(spans: Column) -> Column:
    """Union, touching spans joined."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(span(last["a"], F.greatest(last["b"], x["b"]))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["a"] <= last["b"], joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), none(), step)


def joined_runs(spans: Column, gap: float) -> Column:
    """Runs of spans (already in order) that follow each other within ``gap``."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(span(last["a"], F.greatest(last["b"], x["b"]))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["a"] - last["b"] <= gap, grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, none(), step)


def fragments(start: Column, end: Column, removals: Column) -> Column:
    """What is left of ``start..end`` between ordered removals."""
    return let(F.concat(F.array(span(start, start)), removals, F.array(span(end, end))), _between)


def _between(edges: Column) -> Column:
    def piece(x: Column, k: Column) -> Column:
        reached = F.array_max(F.transform(F.slice(edges, F.lit(1), k), lambda e: e["b"]))
        return F.when((k > 0) & (x["a"] > reached), span(reached, x["a"]))

    return F.array_compact(F.transform(edges, piece))


def length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0.0), lambda acc, x: acc + (x["b"] - x["a"]))


def covered(a: Column, b: Column, spans: Column) -> Column:
    """Seconds of ``a..b`` inside the spans, summed span by span."""
    return F.aggregate(
        spans, F.lit(0.0), lambda acc, x: acc + F.greatest(F.lit(0.0), F.least(x["b"], b) - F.greatest(x["a"], a))
    )


def voiced(a: Column, b: Column, silences: Column) -> Column:
    """Seconds of ``a..b`` that no silence covers."""
    return F.greatest(F.lit(0.0), b - a - covered(a, b, silences))


def nearest(silences: Column, at: Column, reach: float, edge: str, ok) -> Column:
    """The span whose ``edge`` lies nearest ``at`` within ``reach`` and passes ``ok``; the first on ties, or null."""
    near = F.filter(silences, lambda s: (F.abs(s[edge] - at) <= reach + EPS) & ok(s))
    ranked = F.transform(near, lambda s, k: F.struct(F.abs(s[edge] - at).alias("d"), k.alias("k"), s.alias("s")))
    return F.get(F.array_sort(ranked), F.lit(0))["s"]
