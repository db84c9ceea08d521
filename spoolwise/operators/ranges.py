"""Interval joins: equality on the key and on a time bin, so a hot recording is spread over its bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .scans import KEY, by_time, cut_lineage, low_after, peak_before, scan

BIN = "_bin"


def _bins(lo: str | Column, hi: str | Column, width: float) -> tuple[Column, Column]:
    lo = F.col(lo) if isinstance(lo, str) else lo
    hi = F.col(hi) if isinstance(hi, str) else hi
    first = F.floor(lo / width)
    return first, F.greatest(first, F.floor(hi / width))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_range: tuple[str | Column, str | Column],
    right_range: tuple[str | Column, str | Column],
    width: float,
    condition: Column | None = None,
    keys: Sequence[str] = (KEY,),
) -> DataFrame:
    """Pairs of rows whose closed ranges meet (then filtered by ``condition``), each pair once.

    Both sides are copied to every bin they touch; a pair is kept only in the first bin both touch. Columns other
    than the keys must be named apart by the caller.
    """
    l0, l1 = _bins(*left_range, width)
    r0, r1 = _bins(*right_range, width)
    lhs = left.select("*", l0.alias("_l0"), F.explode(F.sequence(l0, l1)).alias(BIN))
    rhs = right.select("*", r0.alias("_r0"), F.explode(F.sequence(r0, r1)).alias(BIN))
    out = lhs.join(rhs, [*keys, BIN]).where(F.col(BIN) == F.greatest("_l0", "_r0"))
    if condition is not None:
        out = out.where(condition)
    return out.drop(BIN, "_l0", "_r0")


HOME = "_home"


def homes(moments: DataFrame, lo: Column, hi: Column, width: float, keys: Sequence[str] = (KEY,)) -> tuple[DataFrame, DataFrame]:
    """``moments`` with ``_home``, the stretch of ``width`` in which ``lo`` lies, and for each home the last stretch that one
    of its moments reaches (``_to``)."""
    first, last = _bins(lo, hi, width)
    own = moments.withColumn(HOME, first)
    reach = moments.select(*keys, first.alias(HOME), last.alias("_to")).groupBy(*keys, HOME).agg(F.max("_to").alias("_to"))
    return own, reach.where(F.col(HOME).isNotNull() & F.col("_to").isNotNull())


def at_homes(reach: DataFrame, rows: DataFrame, row_range: tuple[str | Column, str | Column], width: float, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """``rows`` with ``_home``: once for each home whose moments may meet them, so that a row travels once or twice and not
    once for each moment. Which moments of the home it does meet is for the caller to say."""
    return overlap_join(rows, reach, row_range, ((F.col(HOME) + 0.5) * width, (F.col("_to") + 0.5) * width), width, keys=keys).drop("_to")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_at: tuple[Column, int],
    right_at: tuple[Column, Column | int],
    best: Sequence[str],
    name: str,
    backward: bool = True,
    keys: Sequence[str] = (KEY,),
    chunk_seconds: float = 600.0,
) -> DataFrame:
    """``left`` plus struct ``name``: the right row with the largest ``best`` among those placed before it on the time
    line (``backward=False``: the smallest ``best`` among those after it). Null when there is none.

    Both sides share one time line, cut into chunks: a position is (time, tie), so ties say who comes first. Only the
    ``best`` columns travel, first the ones that decide.
    """
    keys = list(keys)
    payload = F.struct(*best)
    stamp = lambda at: (at[0].alias("_t"), (at[1] if isinstance(at[1], Column) else F.lit(at[1])).alias("_tie"))
    row = F.struct(*[c for c in left.columns if c not in keys])
    lhs = left.select(*keys, *stamp(left_at), row.alias("_row"))
    rhs = right.select(*keys, *stamp(right_at), payload.alias("_best"))
    line = lhs.unionByName(rhs, allowMissingColumns=True)
    kind = peak_before if backward else low_after
    out = scan(line, keys, ["_t", "_tie"], by_time("_t", chunk_seconds), drop=["_best"], _hit=kind(F.col("_best")))
    out = out.where(F.col("_row").isNotNull())
    out = out.select(*keys, *[F.col("_row." + c) for c in left.columns if c not in keys], F.col("_hit").alias(name))
    # as-of joins come in chains, and each reads its input twice: the rows asked about are written between them
    return cut_lineage(out.select(*left.columns, name))
