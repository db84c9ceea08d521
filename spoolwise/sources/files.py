"""Shared reading and writing: one row per small document in, ordered lines out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.scans import KEY


def path_id(path: Column) -> Column:
    """A recording id from a file path; pass another rule to the readers to keep your own ids."""
    return F.xxhash64(path)


def read_documents(spark: SparkSession, paths: str | list[str], rid=path_id) -> DataFrame:
    """recording_id, path, text: one row per file (captions, notes, plans: the size of one recording's text)."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.select(rid(F.col("path")).alias(KEY), "path", F.regexp_replace("text", "^﻿", "").alias("text"))


def json_items(text: Column) -> Column:
    """The elements of a JSON list, each as its own JSON text; null when it is not a list."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def field(item: Column, name: str) -> Column:
    return F.get_json_object(item, f"$.{name}")


def write_lines(lines: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """Ordered ``line`` rows to one text file per recording, streamed in order: no document is ever built in memory."""
    by_file = lines.repartition(KEY).sortWithinPartitions(KEY, *order)
    by_file.select(KEY, F.col("line").alias("value")).write.mode(mode).partitionBy(KEY).text(path)


def join_lines(lines: DataFrame, order: list[str]) -> DataFrame:
    """One text per recording, for documents known to be small."""
    g = lines.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("x"))
    return g.select(KEY, F.array_join("x.line", "\n").alias("text"))
