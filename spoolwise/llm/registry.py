"""The queries of this subpackage over the driver's tables; their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    chat, contamination, filter_audit, licenses, lines, ngram_join, pieces, pivots, quality, resample, secret_scan as sec, shards, substring,
)

SHARDS = 40
ARRIVALS = 2
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sha(c: Column) -> Column:
    return F.sha2(F.encode(c, "utf-8"), 256)


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf, "labels"))
    judged = quality.judge(docs, model)
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "anomaly")


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    told = F.transform("licenses", lambda x: F.concat_ws(":", x["name"], F.round(x["dice"], 6), x["start"], x["end"]))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(told, ",").alias("licenses"))


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = lines.line_decisions(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.array_join("kept_lines", ",").alias("kept_lines"))


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = contamination.find_contamination(docs, table(spark, sf, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (F.get(s, 1) - F.get(s, 0)))
    ids = F.array_join(F.sort_array(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        sha(ids).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    # every document is scanned: the table comes in two rounds, the second against what the first has put into the ledger
    docs = table(spark, sf, "documents").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)).alias("arrival"))
    home, entries = sec.ledger_home(spark), []
    for n in range(ARRIVALS):
        entries = sec.append_unseen(docs.where(F.col("arrival") == n), home, f"round-{n}", entries)
    paths = sec.blobs_of(docs).select("doc_id", "arrival", "blob")
    found = sec.findings(paths, sec.read_ledger(spark, home, entries))
    base = [r.name for r in sec.BASE]
    count = lambda kind: F.size(F.filter("found", lambda s: s["rule"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    own = F.filter("found", lambda s: s["rule"].isin(base))
    return found.select("doc_id", *[count(k) for k in base], sha(joined(own)).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op6_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = substring.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", sha(F.col("kept")).alias("kept_sha256"))


def op7_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = pieces.encode_pieces(docs, PIECE_MODEL, decoded="decoded")
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.encode(F.array_join("ids", ","), "utf-8"), 256).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("same_text"),
    )


def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    placed = shards.assign_shards(sized, "doc_id", [1.0] * SHARDS)
    slots = shards.number_slots(placed, "shard", ["doc_id", "size", "text_crc32", "grown_shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    read = chat.read_back(chat.chat_examples(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(told).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars",
    )


def op10_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf, "documents").select("doc_id", "text"), n=4, percent=85)


def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs, rules = filter_audit.contract_filters(filter_audit.document_stream(spark, f"{sf}/documents.parquet"))
    return filter_audit.audit(docs, table(spark, sf, "labels"), rules)


def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_exact_search(spark: SparkSession, sf: str) -> DataFrame:
    return pivots.search(table(spark, sf, "embeddings").select("vec_id", "embedding"), k=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: f for name, f in globals().items() if name.startswith("op") and callable(f)
}
