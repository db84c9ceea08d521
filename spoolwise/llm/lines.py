"""Line dedup: an exact set-similarity join of lines by their words. Native expressions only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.scans import cut_lineage
from .words import free_names

SIMILAR = (4, 5)
"""Two lines match at a Jaccard similarity of four fifths of their sets of words."""
RANK_CELLS = 1 << 16
"""Cells of the table of word frequencies, one byte each, that the driver reads and tasks get."""
NEAR = 300_000
"""Rows (at most 60 bytes each) up to which a side of a join is sent to every task; more are joined by a shuffle."""
_ROUNDS = (10,)
LONG = 40
"""Words from which on a line has a second signature, of its frequent words, as those 64 bits no longer tell long lines apart."""
_GAPS = "\t\x0b\x0c\r"


def _blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(" " + _GAPS)) == ""


def _lines(text: Column) -> Column:
    """A text's lines with one kind of gap, so that a line's words are its pieces between spaces, but for empty ones."""
    odd = F.contains(text, F.lit(_GAPS[0]))
    for gap in _GAPS[1:]:
        odd = odd | F.contains(text, F.lit(gap))
    return _split(F.when(odd, F.translate(text, _GAPS, " " * len(_GAPS))).otherwise(text))


def _cell(h: Column, cells: int) -> Column:
    """The cell of a word's hash: its upper bits."""
    return F.shiftrightunsigned(h, 65 - cells.bit_length())


def word_ranks(docs: DataFrame, text: str = "text", cells: int = RANK_CELLS) -> bytearray:
    """For each cell of word hashes one more than twice the logarithm of how often its words occur, over all of ``docs``; 1
    says that the cell has one word that occurs once. It comes to the driver as strings of cell (5 hex digits) and rank (one
    letter) for each 1024 cells."""
    word = docs.select(F.explode(_lines(F.col(text))).alias("line")).select(F.explode(F.split("line", " ")).alias("w"))
    word = word.select(_cell(F.xxhash64("w"), cells).cast("int").alias("cell"))
    rank = F.least(F.lit(63), F.floor(2 * F.log2(F.count(F.lit(1)))).cast("int") + 1)
    told = F.concat(F.lpad(F.hex("cell"), 5, "0"), F.char(F.col("rank") + 64)).alias("told")
    each = word.groupBy("cell").agg(rank.alias("rank")).select(F.shiftright("cell", 10).alias("part"), told)
    out = bytearray(cells)
    for r in each.groupBy("part").agg(F.array_join(F.collect_list("told"), "").alias("told")).collect():
        for at in range(0, len(r["told"]), 6):
            out[int(r["told"][at : at + 5], 16)] = ord(r["told"][at + 5]) - 64
    return out


@dataclass(frozen=True)
class WordOrder:
    """The order of words, from rare to frequent: what turns a hash into a number that sorts so (for each cell), the least
    number that may occur twice, and the number below which about half of all words lie."""

    turn: np.ndarray
    twice: int
    half: int

    @staticmethod
    def of(ranks: bytearray) -> WordOrder:
        rank, low = np.frombuffer(bytes(ranks), np.uint8), 65 - len(ranks).bit_length()
        cell, by_rank = np.arange(len(rank)), np.argsort(rank, kind="stable")
        place = np.empty_like(cell)
        place[by_rank] = cell
        weight = np.cumsum(np.where(rank > 0, 2.0 ** ((rank - 1.0) / 2), 0.0)[by_rank])
        number = lambda n: min((int(n) << low) - (1 << 63), (1 << 63) - 1)
        turn = ((cell ^ place ^ len(rank) // 2).astype(np.uint64) << np.uint64(low)).view(np.int64)
        return WordOrder(turn, number((rank <= 1).sum()), number(np.searchsorted(weight, weight[-1] / 2)))


def _sets(line: Column, order: WordOrder) -> Column:
    """A line's distinct words as numbers, the rarest first: the place of the cell in the upper bits, the rest of the hash
    below. The line is one of ``_lines``."""
    hashes = F.array_except(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))
    # one text that Spark folds into an array: an array sent from here is sent number by number
    turn = F.split(F.lit(",".join(map(str, order.turn.tolist()))), ",").cast("array<bigint>")
    # a value that can't be null, or the array would be sorted as objects
    return F.sort_array(F.transform(hashes, lambda h: h.bitwiseXOR(F.coalesce(turn[_cell(h, len(order.turn))], F.lit(0).cast("long")))))


def _row_key(key: str, text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(key))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _pair_filters() -> Column:
    """Conditions on two postings a and b of one word."""
    top, bottom = SIMILAR
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    total = a("n") + b("n")
    length = bottom * F.least(a("n"), b("n")) >= top * F.greatest(a("n"), b("n"))
    # both prefixes meet here first: what follows bounds what they share
    position = (top + bottom) * F.least(a("n") - a("at"), b("n") - b("at")) >= top * total
    # words that one line alone has are at least as many as the bits in which the signatures differ: the first one of the
    # rarer words, the second one of the others, if both lines are long
    one, two = a("parity").bitwiseXOR(b("parity")), a("parity2").bitwiseXOR(b("parity2"))
    differ = F.bit_count(one) + F.when((a("n") > LONG) & (b("n") > LONG), F.bit_count(two)).otherwise(0)
    near = lambda bits: (top + bottom) * bits <= (bottom - top) * total
    # most pairs end at the first test, so it reads little
    return (a("word") == b("word")) & near(F.bit_count(one)) & length & position & near(differ)


def line_classes(docs: DataFrame, key: str, text: str, words: WordOrder) -> DataFrame:
    """Distinct sets of words with their first line: ``id``, ``n``, two signatures, ``first`` (key, line, row, prefix)."""
    top, bottom = SIMILAR
    rows = docs.select(F.col(key).alias("key"), _row_key(key, text).alias("row"), F.posexplode(_lines(F.col(text))).alias("line", "_text"))
    rows = rows.where(~_blank(F.col("_text"))).select("key", "row", "line", _sets(F.col("_text"), words).alias("_set"))
    n, half = F.size("_set"), F.lit(words.half).cast("long")
    rows = rows.select("*", F.array_position(F.sort_array(F.concat("_set", F.array(half))), half).cast("int").alias("_half"))
    zero, bit = F.lit(0).cast("long"), lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))
    sign = lambda own: F.aggregate(own, zero, lambda s, w: s.bitwiseXOR(bit(w)))
    parity, parity2 = sign(F.slice("_set", 1, F.col("_half") - 1)), F.when(n > LONG, sign(F.slice("_set", F.col("_half"), n))).otherwise(zero)
    # a word that occurs once meets no other line: it keeps its place, without a posting
    prefix = F.transform(F.slice("_set", 1, n - F.ceil(n * top / bottom).cast("int") + 1), lambda w: F.when(w >= F.lit(words.twice), w.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")))
    # sets of three words or fewer match equal sets only
    prefix = F.when(n > bottom - 2, prefix).otherwise(F.array().cast("array<int>"))
    rows = rows.select(F.xxhash64("_set").alias("id"), n.alias("n"), parity.alias("parity"), parity2.alias("parity2"),
                       F.struct("key", "line", "row", prefix.alias("prefix")).alias("_first"))
    return rows.groupBy("id", "n", "parity", "parity2").agg(F.min("_first").alias("first"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` and ``kept``: for each row of ``docs`` that keeps a line with words, the numbers of those lines, from 0.

    A line is removed if a line before it, by (key, line number), has the same set of words or one with a Jaccard
    similarity of at least ``SIMILAR``, whether that one was removed or not. Lines without words never count. Words are
    runs of anything but white space. Rows are told apart by key and text: rows that repeat both fare alike. A null key
    comes first.

    Method: equal sets become one class with its first line. Words are ordered by rarity; each class posts the words of
    its prefix. Postings with no partner that passes the length, positional and parity filters go. The rest meet in
    rounds: every class is compared with the one among the first two of its lists that it meets most often, and those
    not removed yet with the first few of each list and then with the next ones, so that many variants of one line don't
    meet in all pairs. Jaccard is checked on the whole sets.
    """
    words = WordOrder.of(word_ranks(docs, text))
    classes = cut_lineage(line_classes(docs, key, text, words))
    post = classes.select("id", "n", "parity", "parity2", F.posexplode("first.prefix").alias("at", "word")).where("word is not null")
    met = cut_lineage(post.alias("b").join(post.alias("a"), _pair_filters() & (F.col("a.id") != F.col("b.id")), "left_semi"))
    found = met.join(classes.select("id", "first.key", "first.line", "first.row"), "id")
    order = Window.partitionBy("word").orderBy("key", "line", "id")
    lists = cut_lineage(found.withColumn("place", F.row_number().over(order)))
    removed = None
    if lists.where("place > 1").head(1):
        sets = cut_lineage(_whole_sets(docs, text, key, lists, words))
        first = _pairs(lists.where("place <= 2"), lists).groupBy("ib", "ia").agg(F.count(F.lit(1)).alias("n"))
        first = first.groupBy("ib").agg(F.max(F.struct("n", "ia"))["ia"].alias("ia"))
        removed, low = cut_lineage(_alike(first, sets)), 0
        for high in (*_ROUNDS, None):
            late = cut_lineage(lists.where(F.col("place") > low + 1).join(_small(removed), "id", "left_anti"))
            if late.head(1):
                hubs = lists.where((F.col("place") > low) & (F.col("place") <= high if high else F.lit(True)))
                more = _alike(_pairs(hubs, _small(late)).select("ia", "ib").distinct(), sets)
                removed = cut_lineage(removed.union(more))
            low = high
    kept = classes if removed is None else classes.join(removed, "id", "left_anti")
    return kept.groupBy(F.col("first.row").alias("row")).agg(F.sort_array(F.collect_set("first.line")).alias("kept"))


def _small(rows: DataFrame) -> DataFrame:
    """Rows of a written table, sent to every task while they are few; more are joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= NEAR else rows


def _pairs(early: DataFrame, late: DataFrame) -> DataFrame:
    """Pairs (``ia`` before ``ib``) that stand in one list and pass the filters."""
    met = early.alias("a").join(late.alias("b"), _pair_filters() & (F.col("a.place") < F.col("b.place")) & (F.col("a.id") != F.col("b.id")))
    return met.select(F.col("a.id").alias("ia"), F.col("b.id").alias("ib"))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``id`` of each later class of a pair whose sets reach ``SIMILAR``."""
    top, bottom = SIMILAR
    pairs = cut_lineage(pairs.select("ia", "ib"))
    side = lambda i, name: sets.select(F.col("id").alias(i), F.col("set").alias(name)).join(_small(pairs), i)
    both = side("ia", "sa").join(side("ib", "sb"), ["ia", "ib"])
    enough = (top + bottom) * F.size(F.array_intersect("sa", "sb")) >= top * (F.size("sa") + F.size("sb"))
    return both.where(enough).select(F.col("ib").alias("id")).distinct()


def _whole_sets(docs: DataFrame, text: str, key: str, lists: DataFrame, words: WordOrder) -> DataFrame:
    """``id`` and ``set`` of the classes in ``lists``, read again from the texts of their first lines."""
    need = lists.groupBy("row").agg(F.collect_set("line").alias("_lines"))
    few = need.count() <= NEAR and lists.select("row", "line").distinct().count() <= NEAR
    rows = docs.select(_row_key(key, text).alias("row"), F.col(text).alias("_text")).join(F.broadcast(need) if few else need, "row")
    own = rows.select(F.posexplode(_lines(F.col("_text"))).alias("line", "_line"), "_lines").where(F.array_contains("_lines", F.col("line")))
    return own.select(_sets(F.col("_line"), words).alias("set")).select(F.xxhash64("set").alias("id"), "set").dropDuplicates(["id"])


def line_decisions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_lines``, ``n_removed`` and ``kept_lines`` (numbers from 0, lines without words included) of each row.

    A null text has no lines; an empty one has one, without words. See ``repeated_lines``.
    """
    blank = F.array_compact(F.transform(_split(F.col(text)), lambda x, i: F.when(_blank(x), i)))
    rows = docs.select(key, _row_key(key, text).alias("row"), F.when(F.col(text).isNull(), 0).otherwise(F.size(_split(F.col(text)))).cast("long").alias("n_lines"),
                       F.when(F.col(text).isNull(), F.array().cast("array<int>")).otherwise(blank).alias("_blank"))
    out = rows.join(repeated_lines(docs, key, text), "row", "left")
    kept = F.sort_array(F.concat("_blank", F.coalesce("kept", F.array().cast("array<int>"))))
    return out.select(key, "n_lines", (F.col("n_lines") - F.size(kept)).alias("n_removed"), kept.alias("kept_lines"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``; a null text stays null, and no row goes."""
    names = docs.columns
    row, own = free_names(names, "_row", "_kept")
    kept = repeated_lines(docs, key, text).select(F.col("row").alias(row), F.col("kept").alias(own))
    out = docs.withColumn(row, _row_key(key, text)).join(kept, row, "left")
    stays = lambda x, i: _blank(x) | F.coalesce(F.array_contains(own, i), F.lit(False))
    cut = F.array_join(F.filter(_split(F.col(text)), stays), "\n")
    return out.withColumn(text, F.when(F.col(text).isNotNull(), cut)).select(*names)
