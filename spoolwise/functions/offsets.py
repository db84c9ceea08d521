"""Running values over the arrays of one row, and places of matches in a text, in time that grows with their number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .let import let

BLOCK = 256
"""Items that are folded one by one; each item copies what its own block holds so far, never the whole array."""
_BOM = bytearray(b"\x00\x00\xfe\xff")


def _fold(values: Column, join: Callable[[Column, Column], Column], kind: str) -> Column:
    none = F.array().cast(f"array<{kind}>")
    return F.aggregate(values, none, lambda acc, v: F.array_append(acc, F.when(F.size(acc) == 0, v).otherwise(join(F.element_at(acc, -1), v))))


def running(values: Column, join: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """For each item of an array of numbers ``join`` over it and all before it; ``join`` is associative.

    The array is cut into blocks; a block is folded by itself, the blocks' last values are folded, and each block takes
    in what lies before it.
    """
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: _fold(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), join, kind))

    def joined(blocks: Column) -> Column:
        ahead = _fold(F.transform(blocks, lambda b: F.element_at(b, -1)), join, kind)
        return let(ahead, lambda a: F.flatten(F.transform(blocks, lambda b, n: F.transform(b, lambda v: F.when(n > 0, join(F.get(a, n - 1), v)).otherwise(v)))))

    return F.when(F.size(values) > 0, let(cut, joined)).otherwise(F.array().cast(f"array<{kind}>"))


def match_ends(text: Column, found: Column, pattern: str) -> Column:
    """Where each match of ``found`` ends, in characters: the lengths of the matches and of the gaps between them add up."""
    sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    return let(sizes, lambda s: running(s, lambda a, b: a + b))


def pieces_between(text: Column, starts: Column, ends: Column) -> Column:
    """The stretches ``starts[n]..ends[n]`` of a text as an array of strings. With four bytes to each character a stretch is
    found without walking the text up to it."""
    wide = F.encode(text, "UTF-32")
    return let(wide, lambda w: F.zip_with(starts, ends, lambda a, b: F.decode(F.concat(F.lit(_BOM), F.substring(w, a * 4 + 1, (b - a) * 4)), "UTF-32")))
