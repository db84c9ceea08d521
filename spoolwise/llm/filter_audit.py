"""Filter interaction audit: an incremental stream over all files whose late smaller ids take back earlier verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window

from ..operators.scans import cut_lineage, shared_path
from .words import free_names

BATCHES = 8
"""Micro-batches into which the files are dealt; a batch grows with the table."""
_WORDS = "[\\x20\\x09-\\x0D]+"
_LOG = "digest binary, id {id}, mask int, part string, good boolean, toxic boolean, n long, live boolean, plain long, copied long"


def contract_filters(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with the columns that the rules need, and the rules A to D as failure conditions; E, a copy of a smaller
    key's text, is the audit's own."""
    whole, words = free_names(docs.columns, "_whole", "_words")
    out = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(words, F.split(F.btrim(F.col(whole), F.lit(" \t\n\x0b\x0c\r")), _WORDS))
    blank = F.get(words, 0) == ""
    count, distinct = F.when(blank, 0).otherwise(F.size(words)), F.when(blank, 0).otherwise(F.size(F.array_distinct(words)))
    return out, {
        "A": count < 200,
        "B": 100 * distinct < 50 * count,
        "C": 100 * F.regexp_count(whole, F.lit("[A-Z]")) > 2 * F.char_length(whole),
        "D": F.col(whole).rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, key: str, text: str, part: str, filters: Mapping[str, Column]) -> DataFrame:
    """(id, part, digest, mask) of each document: which filters its text fails, and the address of its text."""
    bits = [F.when(c, F.lit(1 << n)).otherwise(0) for n, c in enumerate(filters.values())]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.encode(whole, "utf-8"), 256)).alias("digest"), mask.cast("int").alias("mask"))


def _verdicts(labels: DataFrame, key: str, good: str, toxic: str) -> DataFrame:
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    return labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(said(good).alias("good"), said(toxic).alias("toxic"))


def _settle(rows: DataFrame, known: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of the log for one micro-batch.

    ``rows`` are its documents; ``known`` is the keyed state, the documents of least id of every text that earlier batches
    held. A text's copies are counted together first, so at most one row for each (text, part, verdict) meets the
    state. ``plain`` and ``copied`` are what the row adds to the counters of its mask without and with the copy filter: a row
    of the state that is no longer least is taken out of the one and put into the other.
    """
    told = rows.join(verdicts, "id", "left").select(
        F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"), "id", "mask", "part",
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    same = told.groupBy("digest", "id", "mask", "part", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    new = same.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("all"), F.min(F.struct("id", "n")).alias("first"))
    new = new.select("digest", F.col("first.id").alias("id"), "mask", "part", "good", "toxic", F.col("first.n").alias("n"), "all", F.lit(True).alias("new"))
    touched = new.select("digest").distinct()
    old = known.join(touched, "digest", "left_semi").select("digest", "id", "mask", "part", "good", "toxic", "n", F.lit(0).cast("long").alias("all"), F.lit(False).alias("new"))
    w = Window.partitionBy("digest")
    both = new.unionByName(old).withColumn("was", F.min(F.when(~F.col("new"), F.col("id"))).over(w)).withColumn("least", F.min("id").over(w))
    first = F.col("digest").isNull() | (F.col("id") == F.col("least"))
    single = F.when(F.col("digest").isNull(), F.col("all")).when(first, F.col("n")).otherwise(0)
    back = ~F.col("new") & (F.col("id") == F.col("was")) & (F.col("least") < F.col("was"))
    both = both.where(F.col("new") | back)
    return both.select(
        "digest", "id", "mask", "part", "good", "toxic", "n", (F.col("new") & first & F.col("digest").isNotNull()).alias("live"),
        F.when(F.col("new"), single).otherwise(-F.col("n")).alias("plain"), F.when(F.col("new"), F.col("all") - single).otherwise(F.col("n")).alias("copied"))


def copy_counters(
    stream: DataFrame, labels: DataFrame, filters: Mapping[str, Column], key: str = "doc_id", text: str = "text", part: str = "source",
    label_key: str = "doc_id", good: str = "quality", toxic: str = "toxic",
) -> DataFrame:
    """``part``, ``mask``, ``good``, ``toxic`` and ``n``: how many documents of the stream fail which filters.

    ``stream`` is a streaming frame of documents; all that its source holds now is worked off as available-now
    micro-batches. The bit above those of ``filters`` stands for the copy filter: set for a document whose text equals
    that of a document with a smaller key anywhere in the table. That is known only at the end, so the counters are
    kept by retraction: the state holds the least id of each text (by its SHA-256), and when a later batch brings a smaller one,
    what the earlier one had added is taken back.

    Each batch writes its own folder of the log (state and counter changes in one table), under its number, so a batch that
    is run again after a failure replaces what it wrote; the source's progress lies beside it. Only ids, digests and
    masks leave the scan. Result and cost don't depend on how files are dealt to batches.
    """
    spark, home = stream.sparkSession, shared_path(stream.sparkSession)
    named = masks(stream, key, text, part, filters)
    verdicts = cut_lineage(_verdicts(labels, label_key, good, toxic))
    schema = _LOG.format(id=stream.schema[key].dataType.simpleString())
    copied = 1 << len(filters)
    log = lambda upto: spark.read.schema(schema).parquet(*[f"{home}/log/{n}" for n in range(upto)]) if upto else spark.createDataFrame([], schema)
    done = [0]

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/{number}")
        rows = spark.read.schema(named.schema).parquet(f"{home}/rows/{number}")
        _settle(rows, log(number).where("live"), verdicts).write.mode("overwrite").parquet(f"{home}/log/{number}")
        done[0] = number + 1

    asked = named.writeStream.foreachBatch(one).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()
    asked.awaitTermination()
    changes = log(done[0])
    sides = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("plain").alias("n")), F.struct((F.col("mask") + copied).alias("mask"), F.col("copied").alias("n"))))
    return changes.select("part", "good", "toxic", sides.alias("_s")).groupBy("part", F.col("_s.mask").alias("mask"), "good", "toxic").agg(F.sum("_s.n").alias("n")).where("n <> 0")


def interactions(counters: DataFrame, names: Sequence[str]) -> DataFrame:
    """For every order of the filters and each of its steps what the step's filter does in a part; see ``audit``.

    Nothing but a part's counters is needed: one number for each set of failed filters, of all, good and toxic documents.
    """
    k = len(names)
    count = lambda m, c: F.coalesce(F.sum(F.when((F.col("mask") == m) & c, F.col("n"))), F.lit(0)).cast("long")
    cells = lambda c: F.array(*[count(m, c) for m in range(1 << k)])
    parts = counters.groupBy("part").agg(cells(F.lit(True)).alias("n"), cells(F.col("good")).alias("g"), cells(F.col("toxic")).alias("t"))
    bit = {f: 1 << i for i, f in enumerate(names)}
    steps = [("".join(p), s + 1, bit[p[s]], sum(bit[f] for f in p[:s])) for p in permutations(names) for s in range(k)]
    # a constant text that each part is exploded by: the same steps as structs take seconds to plan
    said = F.lit(",".join(f"{o}:{s}:{b}:{a}" for o, s, b, a in steps))
    rows = parts.select("*", F.explode(F.split(said, ",")).alias("s")).withColumn("s", F.split("s", ":")).select(
        "part", "n", "g", "t", F.get("s", 0).alias("filter_order"), *[F.get("s", i).cast("int").alias(c) for i, c in enumerate(("step", "own", "ahead"), 1)])

    def over(column: str, wanted, weight=lambda m: 1) -> Column:  # noqa: ANN001
        zero = F.lit(0).cast("long")
        return F.aggregate(F.transform(column, lambda v, m: F.when(wanted(m), v * weight(m)).otherwise(zero)), zero, lambda a, v: a + v)

    own, ahead = F.col("own"), F.col("ahead")
    removed = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(ahead) == 0)
    # of all orders, those in which the filter is the first of the failed ones
    share = lambda m: F.floor(F.lit(factorial(k)) / F.bit_count(m)).cast("long")
    return rows.select(
        "part", "filter_order", "step",
        over("n", lambda m: m.bitwiseAND(own.bitwiseOR(ahead)) == 0).alias("kept"),
        over("n", removed).alias("removed"),
        over("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(ahead) != 0)).alias("redundant"),
        F.element_at("n", own + 1).alias("unique_fails"), over("g", removed).alias("good_lost"), over("t", removed).alias("toxic_lost"),
        over("n", lambda m: m.bitwiseAND(own) != 0, share).alias("shapley"))


def audit(
    stream: DataFrame, labels: DataFrame, filters: Mapping[str, Column], copy_name: str = "E", **columns: str,
) -> DataFrame:
    """One row for each part, order of the filters and step, with ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost`` and ``shapley`` (the filter's removals summed over all orders).

    A null part counts as the empty string, a null text as empty (and equal to an empty one), a document without a key
    fails the copy filter never and makes no other fail it; documents of equal key and text are no copies of each other. A label
    row says good or toxic by the value 1; of several for one key any will do. No documents, no rows. At most 8 filters, as
    all their orders are listed. Other columns are not looked at. See ``copy_counters`` for the method.
    """
    if not 1 <= len(filters) + 1 <= 8:
        raise ValueError("between one and eight filters")
    counters = cut_lineage(copy_counters(stream, labels, filters, **columns))
    return interactions(counters, [*filters, copy_name])


def document_stream(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """The Parquet files at ``path``, a folder or one file, as a stream in about ``batches`` micro-batches."""
    still = spark.read.parquet(path)
    files = max(1, -(-len(still.inputFiles()) // batches))
    # as a pattern: a path that is one file is no base for a stream
    return spark.readStream.schema(still.schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
