"""Private details in text lines and on screens: finding, masking, boxes, read-back."""

from __future__ import annotations

import itertools
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import boxes as bx, offsets as off
from ..functions.let import let
from ..functions.lexicon import SENSITIVE
from .folds import ordered_fold
from .intervals import elementary, merge_intervals
from .ranges import overlap_join
from .scans import KEY, after, before, by_time, cut_lineage, low_after, peak_before, scan, shared_path, upto

HIT = "array<struct<kind:string,start:int,end:int,match:string>>"
BLOCK = 64  # free patterns searched in one pass over the lines


# ------------------------------------------------------------------ terms

def compile_terms(lines: list[str]) -> list[str]:
    """A short list of term lines as patterns; ``re:`` starts a regular expression, ``#`` a comment.

    Each costs a search of every text; long dictionaries go through ``term_hits``, which joins on a word.
    """
    out = []
    for line in (ln.strip() for ln in lines):
        if line and not line.startswith("#"):
            body = line[3:] if line.startswith("re:") else r"(?<!\w)" + r"\s+".join(re.escape(w) for w in line.split()) + r"(?!\w)"
            out.append("(?iU)" + body)
    return out


def _folded(text: Column) -> Column:
    """A text with case folded as the patterns of terms fold it."""
    return F.upper(F.translate(text, "\u0130\u212a\u212b\u2126\u03f4\u1e9e", "ik\u00e5\u03c9\u03b8\u00df"))  # those upper case leaves apart


def _folded_words(text: Column) -> Column:
    """The distinct words of a text with case folded as the patterns of terms fold it."""
    return F.array_distinct(F.regexp_extract_all(_folded(text), F.lit(r"(?U)\w+"), F.lit(0)))


SPELLED = r"^[\p{L}\p{N}_]+(?:\\s\+[\p{L}\p{N}_]+)*(?:\\w[*+])?$"
"""Free patterns of nothing but words, ``\\s+`` between them and an open end."""


def _spelled(pattern: Column) -> Column:
    """What a folded text with one space for each run of white space holds wherever the pattern matches; null for other patterns."""
    words = F.replace(F.regexp_replace(pattern, r"\\w[*+]$", ""), F.lit(r"\s+"), F.lit(" "))
    return F.when(pattern.rlike(SPELLED), _folded(words))


def term_patterns(terms: DataFrame, text: str = "text") -> DataFrame:
    """P17 over a table of term lines: each distinct term with its pattern and its ``words``, empty for ``re:`` terms."""
    t = terms.select(F.trim(text).alias("term")).where((F.col("term") != "") & ~F.startswith("term", F.lit("#"))).distinct()
    quoted = F.regexp_replace("term", r"([^\w\s])", r"\\$1")
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)"), F.regexp_replace(quoted, r"\s+", r"\\s+"), F.lit(r"(?!\w)"))
    free = F.startswith("term", F.lit("re:"))
    own = F.when(free, F.concat(F.lit("(?iU)"), F.expr("substring(term, 4)"))).otherwise(pattern)
    return t.select("term", own.alias("pattern"), F.when(free, F.array().cast("array<string>")).otherwise(_folded_words(F.col("term"))).alias("words"))


def term_hits(lines: DataFrame, terms: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """Matches of a dictionary of any size.

    The lines are counted for each word that terms hold, and a term meets only lines with its rarest word; a term with a
    word that no line holds meets none. Words travel with ``ids`` alone. Texts are joined to the pairs that met, where
    the whole term is checked; ``ids`` may repeat or be null. ``re:`` terms and terms without a word have nothing to meet
    by: they are searched ``BLOCK`` at a time, each pass over the lines written before the next. In a pass a pattern that
    is spelled out (``_spelled``) is tried only on lines that hold its words, which a plain search of the folded line tells.
    """
    patterns = term_patterns(terms)
    held = patterns.where(F.size("words") > 0).select("term", "pattern", F.explode("words").alias("word"))
    said = lines.select(*[F.col(c).alias(f"_id{n}") for n, c in enumerate(ids)], F.explode(_folded_words(F.col(text))).alias("word"))
    seen = said.join(held.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("word")).alias("l"), "word")
    rarest = held.join(seen, "word", "left").groupBy("term").agg(F.first("pattern").alias("pattern"), F.min(rank).alias("r"))
    rarest = rarest.where("r.n > 0").select("term", "pattern", F.col("r.word").alias("word"))
    keys = [f"_id{n}" for n in range(len(ids))]
    met = said.join(rarest, "word").select(*keys, "term", "pattern").distinct()
    texts = lines.select(*ids, F.col(text).alias("_line"))
    same = [F.col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, ids)]
    found = F.regexp_extract_all("_line", F.col("pattern"), F.lit(0))
    out = met.join(texts, same).select(*ids, F.lit("term").alias("kind"), "term", F.explode(found).alias("match"))

    free = patterns.where(F.size("words") == 0).withColumn("spelled", F.when(F.startswith("term", F.lit("re:")), _spelled(F.expr("substring(term, 4)"))))
    free, block, path = free.orderBy("term").toLocalIterator(), [], None
    folded = lines.select(*ids, F.col(text).alias("_line"), F.regexp_replace(_folded(F.col(text)), r"(?U)\s+", " ").alias("_folded"))

    def tried(b) -> Column:
        found = F.regexp_extract_all("_line", F.lit(b["pattern"]), F.lit(0))
        if b["spelled"] is not None:
            found = F.when(F.contains("_folded", F.lit(b["spelled"])), found).otherwise(F.array().cast("array<string>"))
        return F.struct(F.lit(b["term"]).alias("term"), found.alias("found"))

    for r in itertools.chain(free, [None]):
        if block and (r is None or len(block) == BLOCK):
            each = F.filter(F.array(*[tried(b) for b in block]), lambda t: F.size(t["found"]) > 0)
            hits = folded.select(*ids, F.explode(each).alias("_t")).select(*ids, F.lit("term").alias("kind"), F.col("_t.term").alias("term"), F.explode("_t.found").alias("match"))
            path, block = path or shared_path(lines.sparkSession), []
            hits.write.mode("append").parquet(path)
        if r is not None:
            block.append(r)
    return out.unionByName(lines.sparkSession.read.schema(out.schema).parquet(path)) if path else out


# ------------------------------------------------------------------ finding

def _matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches of one pattern with their offsets: the lengths of the text between them add up to the offsets."""
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: _placed(text, found, kind, pattern))


def _placed(text: Column, found: Column, kind: str, pattern: str) -> Column:
    ends = off.match_ends(text, found, pattern)
    placed = F.zip_with(found, ends, lambda m, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))
    hits = F.when(F.size(found) > 0, placed).otherwise(F.array().cast(HIT))
    return F.filter(hits, lambda h: bx.luhn(h["match"])) if kind == "card" else hits


# What a text must hold for a kind to occur in it at all: cheap to test, so most texts skip the full patterns.
NEEDS = {
    "email": "@", "phone": r"(?U)\d{3}|\+\d", "ssn": r"(?U)\d{3}[- ]\d{2}[- ]", "card": r"(?U)\d(?:[ -]?\d){12}",
    "key": "sk-|gh[pousr]_|github_pat_|xox[abprs]-|AKIA|AIza|eyJ", "money": "[$€£]|USD|EUR|GBP|dollars", "url": "[/?#]",
    "token": r"[A-Za-z0-9_\-+/=]{24}",
}
ANY = r"(?U)[@\d]|" + NEEDS["key"]  # every kind but email and key has a digit in it


def find_in_text(text: Column, terms: list[str] = (), kinds: dict[str, str] = SENSITIVE) -> Column:
    """Every private detail of a text as ``array<struct<kind,start,end,match>>``, the whole text searched."""
    parts = []
    for k, p in kinds.items():
        hits = _matches(text, k, "(?iU)" + p[4:] if p.startswith("(?i)") else "(?U)" + p)
        if p == SENSITIVE.get(k):
            hits = F.when(text.isNotNull() & ~text.rlike(NEEDS[k]), F.array().cast(HIT)).otherwise(hits)
        parts.append(hits)
    if parts and all(p == SENSITIVE.get(k) for k, p in kinds.items()):
        parts = [F.when(text.isNotNull() & ~text.rlike(ANY), F.array().cast(HIT)).otherwise(F.concat(*parts))]
    return F.concat(*parts, *[_matches(text, "term", p) for p in terms])


def find_sensitive(docs: DataFrame, ids: list[str], text: str = "text", terms: list[str] = (), kinds: dict[str, str] = SENSITIVE) -> DataFrame:
    """One row per private detail."""
    d = docs.select(*ids, F.explode(find_in_text(F.col(text), terms, kinds)).alias("h"))
    return d.select(*ids, "h.kind", "h.start", "h.end", "h.match")


def ocr_lines(words: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """OCR words put back into lines, each with its text and the place of every word in it. A line is small."""
    line = [KEY, "frame_ts", "block", "par", "line"]
    g = words.where(F.col("conf") >= min_confidence).groupBy(*line).agg(
        F.array_sort(F.collect_list(F.struct("word_ix", "text", "x", "y", "w", "h", "conf"))).alias("ws")
    )
    ws = F.col("ws")
    placed = F.transform(
        ws,
        lambda w, k: w.withField("a", F.aggregate(F.slice(ws, F.lit(1), k), F.lit(0), lambda acc, v: acc + F.length(v["text"]) + 1)),
    )
    return g.select(*line, F.array_join("ws.text", " ").alias("text"), placed.alias("ws"))


def _hull(ws: Column) -> Column:
    lo = lambda n: F.array_min(F.transform(ws, lambda w: w[n]))
    hi = lambda n, m: F.array_max(F.transform(ws, lambda w: w[n] + w[m]))
    return bx.box(lo("x"), lo("y"), hi("x", "w") - lo("x"), hi("y", "h") - lo("y"))


def find_on_screen(words: DataFrame, terms: list[str] = ()) -> DataFrame:
    """P15 over OCR words: kind, matched text, and the box around the words the match touches."""
    lines = ocr_lines(words)
    hits = lines.select("*", F.explode(find_in_text(F.col("text"), terms)).alias("hit"))
    touched = F.filter("ws", lambda w: (w["a"] < F.col("hit.end")) & (w["a"] + F.length(w["text"]) > F.col("hit.start")))
    return hits.withColumn("_t", touched).where(F.size("_t") > 0).select(
        KEY, "frame_ts", "block", "par", "line", F.col("hit.kind").alias("kind"), F.col("hit.match").alias("match"), _hull(F.col("_t")).alias("box")
    )


def all_text(words: DataFrame, confidence: float = 40.0, min_length: int = 2) -> DataFrame:
    """One box per line of readable text."""
    ok = words.where((F.col("conf") >= confidence) & (F.length("text") >= min_length))
    return ok.groupBy(KEY, "frame_ts", "block", "par", "line").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("word_ix", "text")))["text"], " ").alias("match"),
        bx.box_hull(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"),
    ).withColumn("kind", F.lit("text"))


# ------------------------------------------------------------------ masking text

FEW = 16  # spans up to which a text is masked by plain substrings


def mask_text(text: Column, hits: Column) -> Column:
    """The text with every hit replaced by ``[kind]``; overlapping hits become one, naming each kind."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("a"), h["end"].alias("b"), h["kind"].alias("k"))))
    return F.when(F.size(hits) == 0, text).otherwise(let(let(ordered, _joined), lambda spans: _fill(text, spans)))


def _joined(hits: Column) -> Column:
    """Ordered hits as spans that don't overlap: one begins at a hit that starts where all before it have ended."""

    def spans(reach: Column) -> Column:
        begins = F.filter(F.transform(hits, lambda h, n: F.when((n == 0) | (h["a"] >= F.get(reach, n - 1)), n)), lambda n: n.isNotNull())

        def one(firsts: Column) -> Column:
            def span(first: Column, n: Column) -> Column:
                upto = F.coalesce(F.get(firsts, n + 1), F.size(hits))
                own = F.slice(hits, first + 1, upto - first)
                return F.struct(F.get(hits, first)["a"].alias("a"), F.get(reach, upto - 1).alias("b"), F.array_distinct(F.transform(own, lambda h: h["k"])).alias("k"))

            return F.transform(firsts, span)

        return let(begins, one)

    return let(off.running(F.transform(hits, lambda h: h["b"]), F.greatest), spans)


def _fill(text: Column, spans: Column) -> Column:
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["b"]))
    ends = F.concat(F.transform(spans, lambda s: s["a"]), F.array(F.length(text)))
    plain = F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))
    kept = F.when(F.size(spans) <= FEW, plain).otherwise(off.pieces_between(text, starts, ends))
    marks = F.concat(F.transform(spans, lambda s: F.concat(F.lit("["), F.array_join(s["k"], ", "), F.lit("]"))), F.array(F.lit("")))
    return F.array_join(F.zip_with(kept, marks, lambda x, m: F.concat(x, m)), "")


def redact_text(docs: DataFrame, text: str = "text", terms: list[str] = (), kinds: dict[str, str] = SENSITIVE) -> DataFrame:
    """Q7 for text tables: ``clean`` text and the number of details masked; unreadable rows have neither."""
    d = docs.withColumn("_hits", find_in_text(F.col(text), terms, kinds))
    return d.withColumns({"clean": mask_text(F.col(text), F.col("_hits")), "masked": F.size("_hits")}).drop("_hits")


def check_and_patch(
    docs: DataFrame, ids: list[str], text: str = "text", terms: list[str] = (), rounds: int = 2, min_length: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Q8: mask, read the result back, mask what is still readable, at most ``rounds`` more times.

    Returns (clean rows, quarantine). Anything still readable, and anything that cannot be read, is quarantined; leaks
    are listed by kind and length, never by text.
    """
    still = lambda c: F.filter(find_in_text(c, terms), lambda h: F.length(F.trim(h["match"])) >= min_length)
    out = redact_text(docs.select(*ids, text), text, terms).select(*ids, "clean")
    done = None
    for n in range(rounds + 1):
        # each round's copy is written before it is read back, as the check must see what was really produced
        out = cut_lineage(cut_lineage(out).withColumn("_left", still(F.col("clean"))))
        if n == rounds:
            break
        # masking nothing changes nothing, so what reads clean (or can't be read) is settled; only leaks go round again
        leaky = F.coalesce(F.size("_left") > 0, F.lit(False))
        settled = out.where(~leaky)
        done = settled if done is None else done.unionByName(settled)
        out = out.where(leaky).withColumn("clean", mask_text(F.col("clean"), F.col("_left"))).drop("_left")
    out = out if done is None else done.unionByName(out)
    leaks = F.transform("_left", lambda h: F.struct(h["kind"].alias("kind"), F.length(h["match"]).alias("characters")))
    out = out.select(*ids, "clean", leaks.alias("leaks"))
    bad = F.col("clean").isNull() | (F.size("leaks") > 0)
    return out.where(~bad).select(*ids, "clean"), out.where(bad).select(*ids, "leaks")


def first_sightings(hits: DataFrame, min_length: int = 3) -> DataFrame:
    """The first time each detail is seen. ``hits``: recording_id, t, kind, match."""
    h = hits.withColumn("match", F.trim("match")).where(F.length("match") >= min_length)
    g = h.groupBy(KEY, "kind", F.lower("match").alias("folded")).agg(F.min(F.struct("t", "match")).alias("f"))
    return g.select(KEY, F.col("f.t").alias("t"), "kind", F.col("f.match").alias("match"))


# ------------------------------------------------------------------ boxes over time

def kind_counts(redactions: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Records per kind; a merged record counts for each of its kinds."""
    why = F.coalesce(F.nullif("why", F.lit("")), F.lit("manual"))
    return redactions.select(*keys, F.explode(F.split(why, ", ")).alias("kind")).groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("records"))


def clip_to_spans(redactions: DataFrame, spans: DataFrame, every: float = 1.0, chunk_seconds: float = 600.0) -> DataFrame:
    """A range reaches at most ``every`` outside the spans it was sampled in. Redactions carry ``red_ix``."""
    line = lambda df, t, tie, v: df.select(KEY, t.alias("_t"), F.lit(tie).alias("_tie"), v.alias("_v"))
    rows = redactions.select(KEY, F.struct("red_ix", "start", "end").alias("_row"), "start", "end")
    a, b, chunk = F.col("start"), F.col("end"), by_time("_t", chunk_seconds)
    lo = line(spans, b, 1, a).unionByName(rows.select(KEY, a.alias("_t"), F.lit(0).alias("_tie"), "_row"), allowMissingColumns=True)
    lo = scan(lo, [KEY], ["_t", "_tie"], chunk, _lo=low_after(F.col("_v"))).where("_row is not null").select(KEY, "_row.red_ix", "_lo")
    hi = line(spans, a, 0, b).unionByName(rows.select(KEY, b.alias("_t"), F.lit(1).alias("_tie"), "_row"), allowMissingColumns=True)
    hi = scan(hi, [KEY], ["_t", "_tie"], chunk, _hi=peak_before(F.col("_v"))).where("_row is not null").select(KEY, "_row.red_ix", "_hi")
    out = redactions.join(lo, [KEY, "red_ix"]).join(hi, [KEY, "red_ix"])
    return out.withColumns({
        "start": F.greatest(a, F.coalesce("_lo", a) - every, F.lit(0.0)), "end": F.least(b, F.coalesce("_hi", b) + every),
    }).select(*redactions.columns)


def coverage(
    redactions: DataFrame, width: int, height: int, grid: int = 8, share: float | None = None, bin_seconds: float = 60.0
) -> DataFrame:
    """Share of the frame blurred in each stretch where the boxes change, on a lattice, nothing counted twice.

    The boxes of a stretch are swept in its row: between two neighbouring edges from top to bottom the same boxes lie
    side by side, so their joined columns times the height add up. No lattice cell or row is ever a row of a table, and
    the work does not depend on ``grid``. The boxes seen at one moment on one screen are few by nature.
    """
    cols, rows = -(-width // grid), -(-height // grid)
    frame = float(width * height)
    parts = elementary(redactions.select(KEY, "start", "end"))
    keys = [KEY, "e_start", "e_end"]
    live = overlap_join(
        parts, redactions.select(KEY, "start", "end", "x", "y", "w", "h"), ("e_start", "e_end"), ("start", "end"), bin_seconds,
        (F.col("start") < F.col("e_end")) & (F.col("end") > F.col("e_start")),
    )
    area = F.col("w") * F.col("h") / F.lit(frame)
    short = None
    if share is not None:
        sums = live.groupBy(*keys).agg(F.sum(area).alias("_sum"), F.max(area).alias("_max"))
        live = live.join(sums, keys)
        settled = (F.col("_sum") <= share) | (F.col("_max") > share)
        short = sums.where(settled).select(
            *keys, F.when(F.col("_sum") <= share, F.least(F.lit(1.0), F.col("_sum"))).otherwise(F.col("_max")).alias("share")
        )
        live = live.where(~settled)
    top, bottom = F.floor(F.col("y") / grid), F.least(F.lit(rows), F.ceil((F.col("y") + F.col("h")) / grid)) - 1
    box = F.struct(
        F.floor(F.col("x") / grid).alias("a"), F.least(F.lit(cols), F.ceil((F.col("x") + F.col("w")) / grid)).alias("b"),
        top.alias("top"), (bottom + 1).alias("bottom"),
    )
    boxes = live.where(bottom >= top).groupBy(*keys).agg(F.array_sort(F.collect_set(box)).alias("_boxes"))
    exact = boxes.select(*keys, (_swept(F.col("_boxes")) / F.lit(cols * rows)).alias("share"))
    out = exact if short is None else exact.unionByName(short)
    return out.select(KEY, F.col("e_start").alias("start"), F.col("e_end").alias("end"), "share")


def _swept(boxes: Column) -> Column:
    """Cells of the lattice under an array of boxes sorted by their left edge ``a``; ``b`` and ``bottom`` lie outside."""
    edges = F.array_sort(F.array_distinct(F.concat(F.transform(boxes, lambda r: r["top"]), F.transform(boxes, lambda r: r["bottom"]))))

    def columns(y: Column) -> Column:
        beside = F.filter(boxes, lambda r: (r["top"] <= y) & (r["bottom"] > y))
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))

        def joined(acc: Column, r: Column) -> Column:
            more = F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], acc["reach"]))
            return F.struct((acc["n"] + more).cast("long").alias("n"), F.greatest(acc["reach"], r["b"]).cast("long").alias("reach"))

        return F.aggregate(beside, none, joined, lambda acc: acc["n"])

    bands = lambda ys: F.transform(ys, lambda y, i: F.coalesce(F.get(ys, i + 1) - y, F.lit(0)) * columns(y))
    return F.aggregate(let(edges, bands), F.lit(0).cast("long"), lambda acc, v: acc + v)


def large_blurs(redactions: DataFrame, width: int, height: int, share: float = 0.4, **options) -> DataFrame:
    """A10: stretches where the blur covers more than ``share`` of the frame, touching neighbours joined."""
    big = coverage(redactions, width, height, share=share, **options).where(F.col("share") > share)
    return merge_intervals(big, share=F.max("share"))


def merge_boxes(redactions: DataFrame, same: float = 0.5) -> DataFrame:
    """Records whose times touch and whose boxes mostly overlap become one, first match first.

    Boxes grow as they merge, so order matters. Records of different stretches of touching times never meet: each
    stretch is its own key, and inside one only the records still open are held.
    """
    chunk = by_time("start", 3600.0)
    order = ["start", "x", "y", "w", "h", "end", "why"]
    r = redactions.select(KEY, *order)
    d = scan(r, [KEY], order, chunk, _peak=peak_before(F.col("end")))
    opens = F.col("_peak").isNull() | (F.col("start") - F.col("_peak") > 1e-6)
    d = scan(d.withColumn("_o", F.when(opens, F.col("start"))).drop("_peak"), [KEY], order, chunk, _island=upto(F.col("_o")))
    schema = f"{KEY} long, start double, end double, x int, y int, w int, h int, why string"
    alone = F.count(F.lit(1)).over(Window.partitionBy(KEY, "_island")) == 1
    d, out = d.drop("_o").withColumn("_alone", alone), [KEY, "start", "end", "x", "y", "w", "h", "why"]
    merged = ordered_fold(d.where("not _alone").select(*out, "_island"), [KEY, "_island"], order, lambda: _box_merger(same), schema)
    return d.where("_alone").select(*out).unionByName(merged)  # most records meet no other: they never leave the JVM


def _box_merger(same: float):
    held: list[list] = []  # [start, end, x0, y0, x1, y1, why], in order of creation
    key = [None]

    def boxes(closed: list[list]) -> list[tuple]:
        return [(key[0], a, b, x0, y0, x1 - x0, y1 - y0, why) for a, b, x0, y0, x1, y1, why in closed]

    def share(o: list, x0: int, y0: int, x1: int, y1: int) -> float:
        both = max(0, min(o[4], x1) - max(o[2], x0)) * max(0, min(o[5], y1) - max(o[3], y0))
        small = min((o[4] - o[2]) * (o[5] - o[3]), (x1 - x0) * (y1 - y0))
        return both / small if small else 0.0

    def step(rows: list[tuple] | None) -> list[tuple]:
        if rows is None:
            return boxes(held)
        closed: list[list] = []
        for rid, a, b, x, y, w, h, why, _ in rows:
            key[0] = rid
            closed += [o for o in held if a > o[1] + 1e-6]
            held[:] = [o for o in held if a <= o[1] + 1e-6]
            for o in held:
                if share(o, x, y, x + w, y + h) >= same:
                    o[1], o[2], o[3], o[4], o[5] = max(o[1], b), min(o[2], x), min(o[3], y), max(o[4], x + w), max(o[5], y + h)
                    if why not in o[6].split(", "):
                        o[6] = f"{o[6]}, {why}".strip(", ")
                    break
            else:
                held.append([a, b, x, y, x + w, y + h, why])
        return boxes(closed)

    return step


# ------------------------------------------------------------------ screens

def screen_runs(frames: DataFrame, every: float = 1.0, still: float = 0.01, delta: int = 12, differs: int = 8, reread: float = 3.0) -> DataFrame:
    """Frames plus ``run`` (one unchanged screen) and ``read`` (which frames of it to read).

    A frame belongs to the run when it is like the run's first frame, which moves with every run: the frames stream
    through in order, and only the run's head, the last frame read and the last frame seen are held. Recordings are
    split where frames are further apart than ``every``, since no run crosses such a gap.
    """
    d = scan(frames, [KEY], ["ts"], by_time("ts", 3600.0), _p=before(F.col("ts")))
    opens = F.col("_p").isNull() | (F.col("ts") - F.col("_p") > every + 0.01)
    d = scan(d.withColumn("_o", F.when(opens, F.col("ts"))).drop("_p"), [KEY], ["ts"], by_time("ts", 3600.0), _part=upto(F.col("_o")))
    schema = f"{KEY} long, ts double, run_start double, read boolean"
    return ordered_fold(d.select(KEY, "_part", "ts", "thumb"), [KEY, "_part"], ["ts"], lambda: _screen_reader(still, delta, differs, reread), schema)


def _screen_reader(still: float, delta: int, differs: int, reread: float):
    s: dict = {"head": None, "t0": None, "seen": None, "at": None, "held": None}

    def gap(a, b):
        return None if a is None or b is None or len(a) == 0 or len(a) != len(b) else np.abs(a - b)

    def settle(last: bool) -> list:
        """The held frame's row; the last frame of a run is read when a second has passed since the last reading."""
        if s["held"] is None:
            return []
        rid, t, run, read = s["held"]
        s["held"] = None
        return [(rid, t, run, bool(read or (last and t - s["at"] >= 1.0)))]

    def step(frames: list[tuple] | None) -> list[tuple]:
        if frames is None:
            return settle(True)
        rows = []
        for rid, _, t, thumb in frames:
            thumb = None if thumb is None else np.asarray(thumb, dtype="int64")
            d = gap(s["head"], thumb)
            changed = 1.0 if d is None else float((d > delta).sum()) / len(d)
            if s["t0"] is not None and changed < still:
                rows += settle(False)
                e = gap(s["seen"], thumb)
                read = (255 if e is None else int(e.max())) >= differs or t - s["at"] >= reread
            else:
                rows += settle(True)
                s["head"], s["t0"], read = thumb, t, True
            if read:
                s["seen"], s["at"] = thumb, t
            s["held"] = (rid, t, s["t0"], read)
        return rows

    return step


def spread_hits(runs: DataFrame, hits: DataFrame, width: int, height: int, every: float = 1.0, pad: int = 6) -> DataFrame:
    """Boxes found on the frames read, blurred over their whole run: from the frame before it to the frame after it.

    ``runs`` as made by ``screen_runs``; ``hits``: recording_id, frame_ts, kind, box.
    """
    g = runs.groupBy(KEY, "run_start").agg(F.max("ts").alias("run_end"))
    g = scan(g, [KEY], ["run_start"], by_time("run_start", 3600.0), _p=before(F.col("run_end")), _n=after(F.col("run_start")))
    near = lambda a, b: F.coalesce(F.abs(b - a) <= every + 0.01, F.lit(False))
    a, b = F.col("run_start"), F.col("run_end")
    g = g.select(
        KEY, "run_start", F.when(near(F.col("_p"), a), F.col("_p")).otherwise(a - every).alias("start"),
        F.when(near(b, F.col("_n")), F.col("_n")).otherwise(b + every).alias("end"),
    )
    h = hits.select(KEY, F.col("frame_ts").alias("ts"), F.col("kind").alias("why"), "box").join(
        runs.where("read").select(KEY, "ts", "run_start"), [KEY, "ts"]
    ).join(g, [KEY, "run_start"])
    boxed = bx.clamp_box(F.col("box"), F.lit(width), F.lit(height), F.lit(pad) + F.floor(F.col("box.h") / 4))
    return h.withColumn("box", boxed).where(F.col("box").isNotNull()).select(
        KEY, F.greatest(F.lit(0.0), F.col("start")).alias("start"), "end", "box.x", "box.y", "box.w", "box.h", "why"
    )


def redact_screens(
    frames: DataFrame, words: DataFrame, spans: DataFrame, width: int, height: int, every: float = 1.0, terms: list[str] = (),
    whole_lines: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Q7 for screens: runs of still frames, details on the frames read, boxes over the runs, merged and clipped.

    Returns (redactions, warnings of ``gate_large_blurs``).
    """
    runs = screen_runs(frames, every)
    hits = all_text(words) if whole_lines else find_on_screen(words, terms)
    out = merge_boxes(spread_hits(runs, hits, width, height, every))
    out = out.withColumn("red_ix", F.struct("start", "x", "y", "w", "h", "end", "why"))
    return gate_large_blurs(cut_lineage(clip_to_spans(out, spans, every).drop("red_ix")), width, height)


def gate_large_blurs(
    redactions: DataFrame, width: int, height: int, share: float = 0.4, by_hand: bool = False, allow: bool = False, **options,
) -> tuple[DataFrame, DataFrame]:
    """(redactions, notes): stretches where the blur covers more than ``share`` of the frame are noted (``refused`` or not).

    Found boxes stay with a warning. Boxes drawn by hand are refused for a recording with such a stretch, unless
    ``allow`` says that a whole screen may be private.
    """
    notes = cut_lineage(large_blurs(redactions, width, height, share, **options).withColumn("refused", F.lit(by_hand and not allow)))
    if by_hand and not allow:
        redactions = redactions.join(notes.select(KEY).distinct(), KEY, "left_anti")
    return redactions, notes


def add_read_back(redactions: DataFrame, hits: DataFrame, width: int, height: int, every: float = 1.0, pad: int = 6) -> DataFrame:
    """U5 and Q8 for screens: what a read-back still shows becomes extra boxes, two sampling steps to either side and
    padded by half their height, appended and merged. ``hits``: recording_id, frame_ts, kind, box."""
    grown = bx.clamp_box(F.col("box"), F.lit(width), F.lit(height), F.lit(pad) + F.floor(F.col("box.h") / 2).cast("int"))
    t = F.col("frame_ts")
    extra = hits.select(KEY, F.greatest(F.lit(0.0), t - 2 * every).alias("start"), (t + 2 * every).alias("end"), grown.alias("_b"), F.concat("kind", F.lit(" (read back)")).alias("why"))
    extra = extra.where(F.col("_b").isNotNull()).select(KEY, "start", "end", "_b.x", "_b.y", "_b.w", "_b.h", "why")
    return merge_boxes(redactions.select(KEY, "start", "end", "x", "y", "w", "h", "why").unionByName(extra))
