"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its content. The ledger holds what each (blob, rule, rule version) pair gave;
only pairs that are not in it are scanned, and findings are joined back to all paths that held the blob.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.let import let
from ..functions.offsets import match_ends
from ..operators.scans import shared_path

FINDING = "start int, end int"
LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters at least."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


# The rules that the scan must have. A run of one class of characters is never shorter than asked for
# when its length stands in the pattern, so only the first rule has to drop short matches afterwards.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of one rule in code points, end exclusive; native, linear in the text.

    The text is cut at the matches; the lengths of gaps and matches give every offset in one running sum. Texts in
    which the pattern does not occur are passed over by one test.
    """
    def placed(found: Column) -> Column:
        kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
        spans = F.zip_with(found, match_ends(text, found, rule.pattern), lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end")))
        if not rule.least:
            return spans
        told = F.zip_with(spans, kept, lambda s, k: F.struct(s.alias("span"), (F.length(k) >= rule.least).alias("keep")))
        return F.transform(F.filter(told, lambda t: t["keep"]), lambda t: t["span"])

    none = F.array().cast(f"array<struct<{FINDING.replace(' int', ':int')}>>")
    return F.when(text.rlike(rule.pattern), let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), placed)).otherwise(none)


def blobs_of(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``blob``, the SHA-256 of its text; null counts as empty. A column of that name is replaced."""
    return df.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def scan_unseen(
    df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None,
) -> DataFrame:
    """New rows of the ledger (``LEDGER``) for the blobs of ``df``: one for each (blob, rule version) pair not in it.

    Copies of a text are dropped before anything is scanned, at first inside each task, so thousands of copies travel
    as one row a task. A null text is the empty blob, which is in the ledger with no spans like every other; an empty table
    gives no rows; other columns are not looked at.
    """
    blobs = blobs_of(df, text).select("blob", F.coalesce(F.col(text), F.lit("")).alias("_text")).dropDuplicates(["blob"])
    every = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules]
    if ledger is not None:
        known = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("_known"))
        blobs = blobs.join(known, "blob", "left")
        skip = lambda pair: F.coalesce(F.array_contains("_known", pair), F.lit(False))
        blobs = blobs.where(F.col("_known").isNull() | (F.size(F.array_except(F.array(*every), "_known")) > 0))
    else:
        skip = lambda pair: F.lit(False)
    scans = [F.when(~skip(p), F.struct(*p_fields(r), spans_of(F.col("_text"), r).alias("spans"))) for p, r in zip(every, rules)]
    return blobs.select("blob", F.explode(F.array_compact(F.array(*scans))).alias("_s")).select("blob", "_s.*")


def p_fields(rule: Rule) -> list[Column]:
    return [F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version")]


def findings(paths: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``paths`` (with ``blob``) and ``found``: array of (start, kind number, rule, end) of the current rules, in order.

    Only blobs with a finding are joined; all other paths get an empty array. Columns of ``paths`` pass through (``found``
    is replaced), rows that repeat stay, and an empty ledger or no paths are no special case.
    """
    paths = paths.drop("found")
    current = F.array(*[F.struct(*p_fields(r), F.lit(n).alias("kind")) for n, r in enumerate(rules)])
    number = F.filter(current, lambda c: (c["rule"] == F.col("rule")) & (c["version"] == F.col("version")))
    hits = ledger.where(F.size("spans") > 0).withColumn("_k", F.get(number, 0)["kind"]).where("_k is not null")
    item = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("_k").alias("kind"), F.col("rule").alias("rule"), s["end"].alias("end")))
    per = hits.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(item))).alias("found"))
    none = F.array().cast("array<struct<start:int,kind:int,rule:string,end:int>>")
    return paths.join(per, "blob", "left").withColumn("found", F.coalesce("found", none))


def ledger_home(spark: SparkSession) -> str:
    """A new place for a ledger in the shared folder; a ledger that is to last gets a path of its own."""
    return shared_path(spark)


def read_ledger(spark: SparkSession, home: str, entries: Sequence[str]) -> DataFrame | None:
    """The pairs that the named entries of a ledger hold; none without entries."""
    return spark.read.schema(LEDGER).parquet(*[f"{home}/{e}" for e in entries]) if entries else None


def append_unseen(df: DataFrame, home: str, entry: str, before: Sequence[str] = (), text: str = "text", rules: Sequence[Rule] = RULES) -> list[str]:
    """Scan what the ledger's entries ``before`` don't know of ``df`` and write it as ``entry``; the names of all entries.

    An entry is one folder: a round that is run again after a failure replaces its own and no other.
    """
    new = scan_unseen(df, text, rules, read_ledger(df.sparkSession, home, before))
    new.write.mode("overwrite").parquet(f"{home}/{entry}")
    return [*before, entry]
