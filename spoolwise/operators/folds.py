"""Rules that walk rows in order: greedy picking, and streaming folds with constant memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scans import KEY, cut_lineage

POOL = 512  # ranked rows looked at per key and round; later rounds take up what is left


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key. Spark trims every input partition to ``n`` per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def greedy_pick(
    df: DataFrame,
    rank: Sequence[Column],
    k: int,
    conflict: Callable[[Column, Column], Column],
    keys: Sequence[str] = (KEY,),
    pool: int = POOL,
) -> DataFrame:
    """Take rows in rank order, skipping any that conflicts with one taken before, up to ``k`` per key.

    A round folds the best ``pool`` rows per key. Keys that still lack picks and have more rows go into another
    round over everything that does not conflict with their picks, so nothing is cut off; a round adds at least one
    pick, so there are at most ``k`` rounds.
    """
    keys = list(keys)
    values = [c for c in df.columns if c not in keys]
    row = F.struct(*[c.alias(f"_r{n}") for n, c in enumerate(rank)], *[F.col(c) for c in values])
    ranked = df.select(*keys, row.alias("_row"))
    order = [F.col(f"_row._r{n}") for n in range(len(rank))]
    if k == 1:
        best = ranked.groupBy(*keys).agg(F.min("_row").alias("_row"))
        return best.select(*keys, *[F.col("_row." + c) for c in values])

    row_type = ranked.schema["_row"].dataType.simpleString()
    none_yet = F.array().cast(f"array<{row_type}>")
    done, todo = None, ranked.withColumn("_taken", none_yet)
    while True:
        top = top_per_key(todo, keys, order, pool + 1)
        lists = top.groupBy(*keys).agg(F.array_sort(F.collect_list("_row")).alias("_rows"), F.first("_taken").alias("_taken"))
        picked = F.aggregate(
            F.slice("_rows", 1, pool),
            F.col("_taken"),
            lambda acc, x: F.when(
                (F.size(acc) < k) & ~F.exists(acc, lambda p: conflict(p, x)), F.concat(acc, F.array(x))
            ).otherwise(acc),
        )
        state = lists.select(*keys, picked.alias("_taken"), (F.size("_rows") > pool).alias("_more"))
        state = cut_lineage(state)
        open_ = F.col("_more") & (F.size("_taken") < k)
        closed = state.where(~open_).select(*keys, "_taken")
        done = closed if done is None else done.unionByName(closed)
        left = state.where(open_).select(*keys, "_taken")
        if left.isEmpty():
            break
        # a row need not conflict with itself, so what is taken is left out by value as well
        free = ~F.exists("_taken", lambda p: conflict(p, F.col("_row"))) & ~F.array_contains("_taken", F.col("_row"))
        todo = ranked.join(left, keys).where(free)
        # a key whose remaining rows all conflict drops out of the join: its picks are final
        done = done.unionByName(left.join(todo.select(*keys).distinct(), keys, "left_anti"))
        todo = cut_lineage(todo)
    out = done.select(*keys, F.explode("_taken").alias("_row"))
    return out.select(*keys, *[F.col("_row." + c) for c in values])


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], Callable],
    schema: str,
) -> DataFrame:
    """Stream each key's rows in order through a stateful step; memory does not grow with the key.

    ``start()`` makes the step of one key: it gets a list of consecutive rows (tuples in the order of ``df``'s columns) and
    returns a list of result rows for it, carrying its own state to the next list; at the end of the key it gets None
    and returns what it still holds. For rules whose next state needs the whole state before it. A batch becomes rows,
    and its results a frame, once, however many short keys it holds.
    """
    keys, names = list(keys), df.sparkSession.createDataFrame([], schema).columns
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator) -> Iterator:
        current, step = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            heads = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            rows, out = list(zip(*[pdf[c].tolist() for c in pdf.columns])), []
            for a, b in zip(heads, [*heads[1:], len(rows)]):
                key = tuple(rows[a][n] for n in at)
                if key != current:
                    out += step(None) if step else []
                    current, step = key, start()
                out += step(rows[a:b])
            if out:
                yield pd.DataFrame(out, columns=names)
        out = step(None) if step else []
        if out:
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
