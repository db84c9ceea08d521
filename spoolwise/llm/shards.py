"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .words import free_names

_UNIT = 2.0**-53
REPEATS = 1 << 16
"""Copies of one row that are numbered by one array."""


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that wins ``key``: each shard draws ``-ln(u) / weight``, the least draw wins.

    ``u`` depends on key and shard alone, so one more shard takes rows only into itself and a heavier shard takes rows
    only from the others. Equal weights compare the hashes themselves (no logarithm). A shard of weight 0 gets nothing;
    keys may be of any type that hashes (texts too), and a null key
    counts as the number 0. Ties go to the lower number. An empty or negative list of weights is refused.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, with one above zero")
    live = [(n, w) for n, w in enumerate(weights) if w > 0]
    key = F.col(key) if isinstance(key, str) else key
    nulls = key.isNull()  # a null leaves a hash as it is, so it gets the hash of the number 0 by itself

    def draw(n: int, w: float) -> Column:
        h = F.when(nulls, F.xxhash64(F.lit(0).cast("long"), F.lit(n).cast("long"))).otherwise(F.xxhash64(key, F.lit(n).cast("long")))
        if len({w for _, w in live}) > 1:
            h = -F.ln((F.shiftrightunsigned(h, 11) + F.lit(0.5)) * F.lit(_UNIT)) / F.lit(float(w))
        return F.struct(h.alias("draw"), F.lit(n).alias("shard"))

    draws = [draw(n, w) for n, w in live]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def assign_shards(
    df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard", grown: str | None = "grown_shard",
    grown_weight: float = 1.0,
) -> DataFrame:
    """``df`` with its ``shard`` and, if ``grown`` is named, the shard with one shard more. No shuffle."""
    out = df.withColumn(shard, shard_of(F.col(key), weights).cast("int"))
    return out.withColumn(grown, shard_of(F.col(key), [*weights, grown_weight]).cast("int")) if grown else out


def number_slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", cells: int = 256) -> DataFrame:
    """Gapless ``slot`` numbers from 0 in each shard; ``order`` names all columns of ``df`` but ``shard`` that matter.

    Equal rows are counted first, so a key that holds a third of all rows is one row here. A shard is cut into ``cells``
    by hash; rows are numbered inside a cell and a cell starts where the sums of the cells before it end, so no task
    sees a whole shard. That table of cell sums has at most ``cells`` rows a shard. The result holds ``shard``,
    ``order`` and ``slot``.
    """
    cols = [shard, *order]
    n, cell, at, begin, total, block = free_names([*df.columns, slot], "_n", "_cell", "_at", "_start", "_total", "_block")
    equal = df.groupBy(*cols).agg(F.count(F.lit(1)).alias(n)).withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(cells)))
    sums = equal.groupBy(shard, cell).agg(F.sum(n).alias(total))
    before = Window.partitionBy(shard).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(shard, cell, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(begin))
    inside = Window.partitionBy(shard, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn(at, F.coalesce(F.sum(n).over(inside), F.lit(0))).join(starts, [shard, cell])
    first, upto = F.col(begin) + F.col(at), F.col(begin) + F.col(at) + F.col(n)
    # a row that repeats very often becomes blocks first, so that no array of its numbers has more than a block
    dealt = placed.select(*cols, first.alias(begin), upto.alias(total), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / REPEATS))).alias(block))
    low = F.col(begin) + F.col(block) * REPEATS
    return dealt.select(*cols, F.explode(F.sequence(low, F.least(low + REPEATS, F.col(total)) - 1)).alias(slot))


def write_shards(df: DataFrame, shard: str, path: str, mode: str = "errorifexists") -> None:
    """One folder a shard; tasks write the rows they have, so a large shard has many files and nothing is shuffled."""
    df.write.mode(mode).partitionBy(shard).parquet(path)
