"""Text rules as native column expressions: no Python runs per row."""

from __future__ import annotations


from pyspark.sql import Column, functions as F

from .let import let
from .lexicon import CLEANUP, ENGLISH, Lexicon

TOKEN = "[a-z0-9']+"
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+"
TERMINAL_MARK = r"[.!?]\z"


def _count(text: Column, pattern: str) -> Column:
    """Matches of a case-insensitive, Unicode-aware pattern."""
    return F.regexp_count(text, F.lit("(?iU)" + pattern))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(TOKEN))


def content_tokens(text: Column, lex: Lexicon = ENGLISH, min_length: int = 3) -> Column:
    """Tokens without stop words, at least ``min_length`` long, repeats kept."""
    keep = lambda t: ~t.isin(*lex.stop_words) & (F.length(t) >= min_length)
    return F.filter(tokens(text), keep)


def content_set(text: Column, lex: Lexicon = ENGLISH, min_length: int = 3) -> Column:
    return F.array_distinct(content_tokens(text, lex, min_length))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two token sets; 0 when both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def similar_sentences(a: Column, b: Column, limit: float = 0.6) -> Column:
    """Token sets of two sentences overlap by more than ``limit``; never when one is empty."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (jaccard(a, b) > limit)


def keywords(request: Column, lex: Lexicon = ENGLISH) -> Column:
    """Topic words of a request plus their crude stems."""
    drop = lex.stop_words + lex.task_words
    words = F.filter(tokens(request), lambda t: ~t.isin(*drop) & (F.length(t) > 2))

    def forms(w: Column) -> Column:
        stems = [
            F.when(F.endswith(w, F.lit(s)) & (F.length(w) - len(s) >= 3), F.substring(w, F.lit(1), F.length(w) - len(s)))
            for s in lex.suffixes
        ]
        return F.array_compact(F.array(w, *stems))

    return F.array_distinct(F.flatten(F.transform(words, forms)))


def keyword_hits(text: Column, kws: Column) -> Column:
    """Tokens that equal or start with any keyword, one hit per token.

    One pass of one pattern over the text; keywords hold only token characters, so nothing needs quoting.
    """
    pattern = F.concat(F.lit("(?<![a-z0-9'])(?:"), F.array_join(kws, "|"), F.lit(")"))
    return F.when(F.size(kws) == 0, F.lit(0)).otherwise(F.regexp_count(F.lower(text), pattern))


def score_cue(text: Column, seconds: Column, kws: Column | None = None, lex: Lexicon = ENGLISH) -> Column:
    """Keyword hits, words per second, fillers and questions."""
    n = token_count(text)
    score = 0.15 * (n / F.greatest(seconds, F.lit(0.5))) - 0.5 * _count(F.lower(text), lex.filler)
    if kws is not None:
        score = 3.0 * keyword_hits(text, kws) + score
    score = score + F.when(F.contains(text, F.lit("?")), F.lit(0.5)).otherwise(F.lit(0.0))
    return F.when(n == 0, F.lit(0.0)).otherwise(score)


def decision_hits(text: Column, lex: Lexicon = ENGLISH) -> Column:
    return _count(text, lex.decision)


def teachable(text: Column, lex: Lexicon = ENGLISH) -> Column:
    """P5: explanations, rules, how-to phrases and numbers up; banter down."""
    return (
        1.0 * _count(text, lex.explain)
        + 1.0 * _count(text, lex.decide)
        + 0.5 * _count(text, lex.how_to)
        + 0.5 * F.least(_count(text, lex.number), F.lit(3))
        - 1.5 * _count(text, lex.banter)
    )


def content_score(text: Column, seconds: Column, lex: Lexicon = ENGLISH) -> Column:
    """The score of a cue when nothing in particular was asked for."""
    return score_cue(text, seconds, None, lex) + 0.75 * decision_hits(text, lex) + 0.6 * teachable(text, lex)


def score_sentence(text: Column, focus: Column | None = None, lex: Lexicon = ENGLISH) -> Column:
    """Share and number of content words, decisions, teachable phrasing, focus hits."""
    words = token_count(text)
    content = F.size(content_tokens(text, lex))
    score = (
        content / words * 2.0
        + F.least(content, F.lit(12)) * 0.2
        + 1.0 * decision_hits(text, lex)
        + 0.5 * teachable(text, lex)
    )
    if focus is not None:
        score = score + 1.5 * keyword_hits(text, focus)
    return F.when(words < 5, F.lit(0.0)).otherwise(score)


def clean_text(text: Column, lex: Lexicon = ENGLISH) -> Column:
    """Drop fillers, then repair the punctuation they leave."""
    out = F.regexp_replace(text, "(?iU)" + lex.filler, "")
    for pattern, new in CLEANUP:
        out = F.regexp_replace(out, "(?U)" + pattern, new)
    return F.btrim(out, F.lit(" ,;:"))


def drop_unpaired_quotes(text: Column) -> Column:
    """A quote is kept when it opens and the next one closes, or closes and the one before opens.

    Parts between quotes are looked at pairwise, so no state runs along the text.
    """
    paired = let(F.split(text, '"', -1), _pair_quotes)
    return F.when(F.contains(text, F.lit('"')), paired).otherwise(text)


def _pair_quotes(parts: Column) -> Column:
    n = F.size(parts) - 1

    def opens(k: Column) -> Column:
        """Quote ``k`` (1-based, after part ``k``) stands after a space or ``(`` and not before a space."""
        left, right = F.element_at(parts, k), F.element_at(parts, k + 1)
        after_gap = F.when(left == "", k == 1).otherwise(F.right(left, F.lit(1)).isin(" ", "("))
        before_gap = F.when(right == "", k == n).otherwise(F.left(right, F.lit(1)).rlike(r"(?U)\s"))
        return after_gap & ~before_gap

    def kept(k: Column) -> Column:
        return F.when(opens(k), F.when(k < n, ~opens(k + 1)).otherwise(F.lit(False))).otherwise(
            F.when(k > 1, opens(k - 1)).otherwise(F.lit(False))
        )

    def piece(part: Column, ix: Column) -> Column:
        return F.when((ix < n) & kept(ix + 1), F.concat(part, F.lit('"'))).otherwise(part)

    return F.array_join(F.transform(parts, piece), "")


def tidy_sentence(text: Column, lex: Lexicon = ENGLISH) -> Column:
    """Clean, drop unpaired quotes, start with a capital."""
    plain = let(clean_text(text, lex), drop_unpaired_quotes)
    out = F.btrim(F.regexp_replace(plain, r"\s+", " "), F.lit(" ,;:"))
    return let(out, lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, F.lit(2), F.length(t))))


def clip_text(text: Column, limit: int, lex: Lexicon = ENGLISH) -> Column:
    """Clean and cut at a word boundary of the second half, with an ellipsis."""

    def shorten(whole: Column) -> Column:
        cut = F.left(whole, F.lit(limit - 1))
        tail = F.substring(cut, F.lit(limit // 2 + 1), F.lit(limit))
        at_word = F.when(F.contains(tail, F.lit(" ")), F.regexp_replace(cut, r"(?s) [^ ]*\z", "")).otherwise(cut)
        return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.rtrim(at_word, F.lit(" ,;:.")), F.lit("…")))

    return let(clean_text(text, lex), shorten)


def split_sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_BREAK)


def last_sentence(text: Column) -> Column:
    """F8: the last sentence, white space normalised; empty for empty text."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.element_at(split_sentences(flat), -1)


def dangling(text: Column, lex: Lexicon = ENGLISH) -> Column:
    """The setup phrase the last sentence stops on, or null for a finished point."""
    sentence = F.regexp_replace(last_sentence(text), "[\\s\"'“”‘’)\\]]+$", "")

    def spoken(s: Column) -> Column:
        return F.replace(F.lower(F.trim(F.regexp_replace(s, r"[.!?]+$", ""))), F.lit("’"), F.lit("'"))

    return let(sentence, lambda s: let(spoken(s), lambda bare: _setup_of(s, bare, lex)))


def _setup_of(sentence: Column, bare: Column, lex: Lexicon) -> Column:
    tail = F.rtrim(sentence, F.lit(":.…—–-, "))
    mark = F.trim(F.substring(sentence, F.length(tail) + 1, F.length(sentence)))
    words = F.split(F.trim(tail), r"\s+")
    last_four = F.array_join(F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), F.lit(4)), " ")
    open_mark = F.concat(last_four, mark)

    def found(pattern: str, allowed=lambda m: F.lit(True)) -> Column:
        return let(F.regexp_extract(bare, "(?U)" + pattern, 0), lambda m: F.when((m != "") & allowed(m), m))

    unfinished = lambda m: ~m.rlike("(?U)" + lex.setup_finished)
    setups = [found(pattern, unfinished) for pattern in lex.setup_patterns]
    bare_words = F.split(bare, r"\s+")
    last_three = F.array_join(F.slice(bare_words, F.greatest(F.size(bare_words) - 2, F.lit(1)), F.lit(3)), " ")
    setups.append(F.when(F.element_at(bare_words, -1).isin(*lex.open_words), last_three))

    return (
        F.when(sentence == "", F.lit(None).cast("string"))
        .when(sentence.rlike(r"(?:[:…—–,-]|\.\.\.)\z"), open_mark)
        .when(F.endswith(sentence, F.lit("?")), found(lex.setup_rhetorical))
        .otherwise(F.coalesce(*setups))
    )


def best_sentence_for(text: Column, kws: Column, limit: int = 200, lex: Lexicon = ENGLISH) -> Column:
    """The sentence with most keyword hits, the longer one on ties, the first after that."""
    parts = F.filter(
        F.transform(split_sentences(clean_text(text, lex)), lambda p: F.btrim(p, F.lit(" ,"))), lambda p: p != ""
    )
    ranked = F.transform(
        parts,
        lambda p, k: F.struct(
            keyword_hits(p, kws).alias("hits"), F.least(F.length(p), F.lit(limit)).alias("len"), (-k).alias("first"),
            p.alias("text"),
        ),
    )
    ended = let(F.array_max(ranked)["text"], lambda t: F.when(t.rlike(TERMINAL_MARK), t).otherwise(F.concat(t, F.lit("."))))
    return F.coalesce(F.left(ended, F.lit(limit)), F.lit("Clip."))


def quote(words: Column, head: int = 70, tail: int = 18) -> Column:
    """The opening and the last words of a long passage."""

    def short(ws: Column) -> Column:
        n = F.size(ws)
        ends = F.concat(F.slice(ws, 1, head), F.array(F.lit("…")), F.slice(ws, n - tail + 1, F.lit(tail)))
        return F.array_join(F.when(n > head + tail, ends).otherwise(ws), " ")

    return let(words, short)


ANNOTATION_LINE = r"^\s*(?:\([^)]*\)|-+)\s*$"


def strip_annotation_lines(text: Column) -> Column:
    """P20: drop lines that hold only a name in brackets or dashes."""
    lines = F.filter(F.split(text, "\r?\n"), lambda ln: ~ln.rlike(ANNOTATION_LINE) & (F.trim(ln) != ""))
    return F.array_join(F.transform(lines, lambda ln: F.trim(ln)), "\n")


def trim_words(text: Column, kept_from: Column, kept_to: Column) -> Column:
    """keep the words whose centre lies in the kept share of a cue.

    A bracketed name stays with the speech after it, a dash line with the speech before it.
    """
    raw = F.split(text, "\n")
    shaped = F.transform(
        raw,
        lambda ln: F.struct(
            ln.alias("line"),
            ln.rlike(ANNOTATION_LINE).alias("note"),
            F.when(ln.rlike(ANNOTATION_LINE), F.lit(0)).otherwise(F.regexp_count(ln, F.lit(r"\S+"))).alias("n"),
        ),
    )
    return let(shaped, lambda lines: _kept_lines(text, lines, kept_from, kept_to))


def _kept_lines(text: Column, shaped: Column, kept_from: Column, kept_to: Column) -> Column:
    total = F.aggregate(shaped, F.lit(0), lambda acc, x: acc + x["n"])

    def cut(x: Column, k: Column) -> Column:
        before = F.aggregate(F.slice(shaped, 1, k), F.lit(0), lambda acc, y: acc + y["n"])
        # "words + following gap" pieces, so the original spacing inside the kept run survives
        pieces = F.regexp_extract_all(x["line"], F.lit(r"\S+\s*"), F.lit(0))
        kept = F.filter(pieces, lambda _, i: ((before + i + 0.5) / total).between(kept_from, kept_to))
        return F.struct(
            x["line"].alias("line"), x["note"].alias("note"),
            F.when(x["note"], F.lit("")).otherwise(F.rtrim(F.array_join(kept, ""))).alias("kept"),
        )

    joined = let(F.transform(shaped, cut), _with_owners)
    return F.when(total == 0, text).otherwise(joined)


def _with_owners(lines: Column) -> Column:
    def shown(x: Column, k: Column) -> Column:
        speech_after = F.filter(F.slice(lines, k + 2, F.size(lines)), lambda y: ~y["note"])
        speech_before = F.filter(F.slice(lines, 1, k), lambda y: ~y["note"])
        owner = F.when(F.ltrim(x["line"]).startswith("("), F.get(speech_after, F.lit(0))["kept"]).otherwise(
            F.get(speech_before, F.size(speech_before) - 1)["kept"]
        )
        return F.when(~x["note"], F.when(x["kept"] != "", x["kept"])).when(
            F.coalesce(owner, F.lit("")) != "", x["line"]
        )

    return F.array_join(F.array_compact(F.transform(lines, shown)), "\n")


