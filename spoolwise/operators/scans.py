"""Running values along a recording, without ever putting a whole recording into one task.

A window ``partitionBy(recording_id)`` sends every row of a long recording to one task. Here rows are cut into
chunks (a range of the row index, or a stretch of time). Each chunk is scanned by its own window, chunk totals
(one row per chunk) are scanned per recording, and what each chunk inherits is joined back on (key, chunk).
Totals and windows read one shuffle of the input, so the input is worked out once.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

KEY = "recording_id"
CHUNK_ROWS = 1 << 16
CHUNK = "_chunk"
AHEAD = ("after", "onward", "low_after")
_WRITTEN: list[str] = []


@dataclass(frozen=True)
class Running:
    kind: str
    value: Column
    default: object = None


def total(value: Column) -> Running:
    """Sum of this row and all rows before it."""
    return Running("total", value, 0)


def before(value: Column) -> Running:
    """The last non-null value of an earlier row."""
    return Running("before", value)


def upto(value: Column) -> Running:
    """The last non-null value of this or an earlier row."""
    return Running("upto", value)


def after(value: Column) -> Running:
    """The first non-null value of a later row."""
    return Running("after", value)


def onward(value: Column) -> Running:
    """The first non-null value of this or a later row."""
    return Running("onward", value)


def peak_before(value: Column) -> Running:
    """The largest value of all earlier rows."""
    return Running("peak_before", value)


def low_after(value: Column) -> Running:
    """The smallest value of all later rows."""
    return Running("low_after", value)


def by_index(ix: str, rows: int = CHUNK_ROWS) -> Column:
    return F.floor(F.col(ix) / rows)


def by_time(t: str, seconds: float) -> Column:
    return F.floor(F.col(t) / seconds)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, drop: Sequence[str] = (), **values: Running) -> DataFrame:
    """``df`` plus one column per running value; ``order`` must be total within a key and follow ``chunk``.

    All columns of ``df`` travel, whether they are used later or not: select before. Those in ``drop`` serve the values only.
    """
    keys, order = list(keys), list(order)
    kept = [c for c in df.columns if c not in drop]
    row = F.struct(*[F.col(c) for c in kept if c not in keys], *[r.value.alias("_v_" + n) for n, r in values.items()])
    src = df.select(*keys, chunk.alias(CHUNK), row.alias("_row")).repartition(*keys, CHUNK)
    of = lambda c: F.col(c if c in keys else "_row." + c)
    at = F.struct(*[of(c).alias(c) for c in order])

    def summary(name: str, r: Running) -> Column:
        v = of("_v_" + name)
        if r.kind == "total":
            out = F.sum(v)
        elif r.kind == "peak_before":
            out = F.max(v)
        elif r.kind == "low_after":
            out = F.min(v)
        elif r.kind in ("before", "upto"):
            out = F.max_by(v, F.when(v.isNotNull(), at))
        else:
            out = F.min_by(v, F.when(v.isNotNull(), at))
        return out.alias("_s_" + name)

    def fold(v: Column, kind: str, w, inclusive: bool) -> Column:
        """``w`` runs forwards, for the kinds that look ahead backwards: so each row is looked at once, not again for
        every row before it, as with frames that are open towards the end."""
        w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if kind == "total":
            return F.sum(v).over(w)
        if kind == "peak_before":
            return F.max(v).over(w)
        if kind == "low_after":
            return F.min(v).over(w)
        return F.last(v, ignorenulls=True).over(w)

    def folded(d: DataFrame, within: list, by: list, source: str, target: str, closed: set) -> DataFrame:
        """``d`` with the running values that lie in one pass over each partition, or two where some look ahead."""
        parts = lambda w, ns: [fold(F.col(source + n) if source == "_s_" else of(source + n), values[n].kind, w, values[n].kind in closed).alias(target + n) for n in ns]
        back = [n for n, r in values.items() if r.kind in AHEAD]
        forth = [n for n in values if n not in back]
        w = Window.partitionBy(*within).orderBy(*by)
        if not back:
            return d.select("*", *parts(w, forth))
        d = d.select("*", *parts(w, forth), F.row_number().over(w).alias("_at"))  # rows that tie are walked back as they came
        return d.select("*", *parts(Window.partitionBy(*within).orderBy(F.desc("_at")), back)).drop("_at")

    # Spark shuffles once for totals and windows only if both ask for the same rows and columns. So each has a condition
    # that always holds but needs the whole row, and the keys of totals come by an aggregate, which keeps the join's null
    # test of keys above the shuffle.
    totals = src.groupBy(*keys, CHUNK).agg(
        *[summary(n, r) for n, r in values.items()], *[F.any_value(k).alias("_k_" + k) for k in keys], F.any_value("_row").alias("_any")
    ).where(F.col("_any").isNotNull()).drop("_any", *keys).withColumnsRenamed({"_k_" + k: k for k in keys})
    whole = F.get(F.array("_row"), F.pmod(F.coalesce(CHUNK, F.lit(0)), F.lit(1)).cast("int")).isNotNull()
    inherited = folded(totals, keys, [CHUNK], "_s_", "_c_", set()).select(*keys, CHUNK, *["_c_" + n for n in values])
    inclusive = {"total", "upto", "onward"}
    local = folded(src, [*keys, CHUNK], [of(c) for c in order], "_v_", "_l_", inclusive).where(whole)
    out = local.join(inherited, [*keys, CHUNK], "left")

    def merged(name: str, r: Running) -> Column:
        mine, theirs = F.col("_l_" + name), F.col("_c_" + name)
        if r.kind == "total":
            v = mine + F.coalesce(theirs, F.lit(0))
        elif r.kind == "peak_before":
            v = F.greatest(mine, theirs)
        elif r.kind == "low_after":
            v = F.least(mine, theirs)
        else:
            v = F.coalesce(mine, theirs)
        return v.alias(name)

    return out.select(*[of(c).alias(c) for c in kept], *[merged(n, r) for n, r in values.items()])


def with_neighbours(
    df: DataFrame, ix: str, prev: Sequence[str] = (), next: Sequence[str] = (), keys: Sequence[str] = (KEY,),
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``df`` plus structs ``_prev`` / ``_next`` of the rows beside each row; ``ix`` counts without gaps.

    A row on the edge of its chunk is also copied to the chunk next door, so one shuffle is enough and no carry is
    joined back.
    """
    keys, home, pos = list(keys), F.floor(F.col(ix) / rows), F.col(ix) % rows
    places = [home]
    if prev:
        places.append(F.when(pos == rows - 1, home + 1))
    if next:
        places.append(F.when(pos == 0, home - 1))
    d = df.select("*", home.alias("_home"), F.explode(F.array_compact(F.array(*places))).alias(CHUNK))
    w = Window.partitionBy(*keys, CHUNK).orderBy(ix)
    extra = []
    if prev:
        extra.append(F.lag(F.struct(*prev)).over(w).alias("_prev"))
    if next:
        extra.append(F.lead(F.struct(*next)).over(w).alias("_next"))
    return d.select("*", *extra).where(F.col("_home") == F.col(CHUNK)).drop("_home", CHUNK)


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where none is named, a folder of this machine if Spark runs on it alone;
    on a cluster that is an error, as executors would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spoolwise-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def shared_path(spark: SparkSession) -> str:
    """A new name in the shared checkpoint folder; ``drop_staged`` deletes what is written there."""
    path = f"{_shared_folder(spark)}/spoolwise-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from there.

    The files outlive executors, and later reads still prune columns and push filters down.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete what ``cut_lineage`` has written in this process; frames that read it can't be used any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
