"""A corpus pipeline over ``documents``: quality rules, line dedup, n-gram Jaccard join, decontamination, piece encoding.

Each stage takes (spark, docs, sf_dir) and keeps what its operator decides; all but the last return the columns of
documents. Texts are whole, and every row of a stage's input is judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spoolwise.llm import contamination, lines, ngram_join, pieces, quality
from spoolwise.llm.registry import PIECE_MODEL, table
from spoolwise.operators.scans import cut_lineage

WORDS, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie beyond the forest's threshold go."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one are cut out; a document of which no word is left goes."""
    return lines.drop_repeated_lines(docs).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, the one with the least doc_id stays (rows that share it all stay, and
    rows without one)."""
    classes = ngram_join.similar_classes(docs, n=WORDS, percent=PERCENT)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside an occurrence of a benchmark window go."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of each document, and whether they give its text back."""
    done = pieces.encode_pieces(docs, PIECE_MODEL, decoded="decoded")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", (F.col("decoded") == F.col("text")).alias("same_text"))


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination), ("sentencepiece", sentencepiece),
]
# The forest's trees can't be said in SQL; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
