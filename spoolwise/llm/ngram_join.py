"""Jaccard self-join of documents on word n-grams, by a prefix join of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.scans import cut_lineage
from . import graph, sketch, words as W

RANK_BITS = 26
"""Ceiling of the frequency ranks (one byte for each of ``2**RANK_BITS`` cells, 64 MB) that put frequent n-grams last."""
NEAR = 500_000
"""Places of sets at hubs that are sent to every task (40 bytes each); more are joined by a shuffle."""
FILTER_BITS = 27
"""Ceiling of the bit filter for sets that must be compared (16 MB)."""
BLOCK_GRAMS = 2 << 20
"""N-grams that one task compares with as many others; larger groups are compared block by block."""


def gram_sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Distinct n-grams of each row, ascending; fewer words are one sequence, no words an empty set."""
    w = W.find_words(W.LOWER[buf], offsets, W.SPACE)
    hashes = w.hashes()
    grams, _ = W.windows(hashes, w.first, n)
    out = []
    for f, e in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if e - f >= n:
            out.append(np.unique(grams[f : e - n + 1]))
        elif e > f:
            short = W.windows(hashes[f:e], np.array([0, e - f]), e - f, 0)[0]
            out.append(W.mix(short, 900 + e - f))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, whatever the order."""
    return tuple(int(W.mix(grams, s).sum(dtype=np.uint64).astype(np.int64)) for s in (31, 32))


def prefix_size(n: int, percent: int) -> int:
    """Of two sets at least ``percent`` alike, the first so many members of each share one."""
    return n - -(-percent * n // 100) + 1 if n else 0


def ordered(grams: np.ndarray, ranks: np.ndarray, bits: int) -> np.ndarray:
    """Rare n-grams first; one order for the whole corpus."""
    return grams[np.lexsort((grams, ranks[sketch.cells(grams, 0, bits)]))]


def _described(docs: DataFrame, key: str, text: str, n: int, percent: int, ranks, bits: int) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("p", pa.int64()),
                        ("prefix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for a, b, buf, off in W.text_slices(batch.column(1)):
                for i, grams in enumerate(gram_sets(buf, off, n), a):
                    front = ordered(grams, ranks.value, bits)[: prefix_size(len(grams), percent)]
                    rows.append((ids[i], len(grams), *set_key(grams), set_key(front)[0], front.tobytes()))
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(run, "id long, n long, s1 long, s2 long, p long, prefix binary")


_PAIR = "p long, q long"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each n-gram in a group's prefix, with its place."""
    for batch in batches:
        n, p = (batch.column(c).to_numpy() for c in ("n", "p"))
        fronts = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
        sizes = np.array([len(f) for f in fronts], np.int64)
        at = np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(fronts) if fronts else np.zeros(0, np.int64)), pa.array(np.repeat(n, sizes)), pa.array(at.astype(np.int32)),
             pa.array(np.repeat(p, sizes))], ["gram", "n", "at", "p"])


def _stars(percent: int):
    """Rows sorted by (gram, n, group): from each n-gram's groups, links of every group to one of them.

    Sizes that cannot match split a list; a group that passes the length and positional filters with no other one is
    left out. The list itself is never paired off: groups that meet in a list meet at its first group.
    """

    def need(a, b):
        return -(-percent * (a + b) // (100 + percent))

    def stretch(n, at) -> np.ndarray | None:
        """Which rows of one list may match another one."""
        if len(n) < 2:
            return None
        if len(n) <= 256:
            x, y = n[:, None], n[None, :]
            ok = (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (1 + np.minimum(x - at[:, None], y - at[None, :]) - 1 >= need(x, y))
            np.fill_diagonal(ok, False)
            keep = ok.any(1)
            if not keep.any():
                return None
            return np.flatnonzero(keep)
        return np.arange(len(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple | None = None
        rest, out = None, []

        def links(cols, hub):
            gram, n, at, p = cols
            cut = (gram[1:] != gram[:-1]) | (100 * n[:-1] < percent * n[1:])
            first = np.concatenate(([True], cut))
            if hub is not None and hub[0] == gram[0] and 100 * hub[1] >= percent * n[0]:
                first[0] = False
            begin = np.flatnonzero(np.concatenate(([True], first[1:])))
            end = np.concatenate((begin[1:], [len(gram)]))
            many = (end - begin > 1) | ((begin == 0) & ~first[0])
            for b, e in zip(begin[many].tolist(), end[many].tolist()):
                if b == 0 and not first[0]:
                    yield np.full(e, hub[2]), p[:e]
                    continue
                keep = stretch(n[b:e], at[b:e]) if e < len(gram) else (np.arange(e - b) if e - b > 1 else None)
                if keep is not None:
                    k = keep + b
                    yield np.full(len(k) - 1, p[k[0]]), p[k[1:]]

        for batch in batches:
            cols = tuple(batch.column(c).to_numpy() for c in ("gram", "n", "at", "p"))
            if rest is not None:
                cols = tuple(np.concatenate(p) for p in zip(rest, cols))
            # the last list stays for the next batch, unless it alone is a long one: then its first group stands for it
            same = np.flatnonzero(cols[0] != cols[0][-1])
            last = int(same[-1]) + 1 if len(same) else 0
            if len(cols[0]) - last > 1 << 16:
                last = len(cols[0])
            rest = tuple(c[last:] for c in cols)
            if not last:
                continue
            done = tuple(c[:last] for c in cols)
            tail = np.concatenate(([True], (done[0][1:] != done[0][:-1]) | (100 * done[1][:-1] < percent * done[1][1:])))
            out += list(links(done, hub))
            b = int(np.flatnonzero(tail)[-1])
            if not (hub is not None and b == 0 and hub[0] == done[0][0] and 100 * hub[1] >= percent * done[1][0]):
                hub = (done[0][b], done[1][-1], done[3][b])
            else:
                hub = (hub[0], done[1][-1], hub[2])
            if sum(len(o[0]) for o in out) > 1 << 18:
                yield pairs(out)
                out = []
        if rest is not None and len(rest[0]):
            out += list(links(rest, hub))
        if out:
            yield pairs(out)

    def pairs(out) -> pa.RecordBatch:
        cols = np.unique(np.stack([np.concatenate([o[i] for o in out]) for i in range(2)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cols[:, i])) for i in range(2)], ["p", "q"])

    return run


def _linked(percent: int):
    """Rows sorted by (hub, block pair, side): sets that are alike inside one block or across two, as a forest.

    Candidates share n-grams, so overlaps are counted along the n-grams' lists; once two sets are linked, their
    comparisons with each other's links only add what is not reachable yet.
    """
    schema = pa.schema([("a1", pa.int64()), ("a2", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64())])

    def forest(rows: list[tuple]) -> list[tuple]:
        k = len(rows)
        if k < 2:
            return []
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        side = np.array([r[2] for r in rows])
        root = list(range(k))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []

        def link(x: int, y: int) -> None:
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((*rows[x][:2], *rows[y][:2]))

        if k == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            if 100 * both >= percent * (sizes[0] + sizes[1] - both):
                link(0, 1)
            return links
        owner = np.repeat(np.arange(k), sizes)
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(number, kind="stable")
        edge = np.searchsorted(number[order], np.arange(number.max() + 2))
        owner_by = owner[order]
        at = np.concatenate(([0], np.cumsum(sizes)))
        two = side.max() > 0
        for x in range(k):
            if two and side[x]:
                continue
            mine = number[at[x] : at[x + 1]]
            lens = edge[mine + 1] - edge[mine]
            flat = np.repeat(edge[mine] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
            both = np.bincount(owner_by[flat], minlength=k)
            alike = 100 * both >= percent * (sizes[x] + sizes - both)
            alike[x] = False
            if two:
                alike &= side == 1
            for y in np.flatnonzero(alike).tolist():
                link(x, y)
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, seen, out = None, [], set(), []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("p", "i", "j", "s1", "s2", "side", "grams")]
            for p, i, j, s1, s2, side, grams in zip(*cols):
                if now != (p, i, j):
                    out += forest(rows)
                    now, rows, seen = (p, i, j), [], set()
                if (s1, s2) not in seen:
                    seen.add((s1, s2))
                    rows.append((s1, s2, side, grams))
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        out += forest(rows)
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return run


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85, max_filter_bits: int = FILTER_BITS) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` for each row: the least key reachable by links.

    A row's set are its distinct n-grams of lower-cased words (white space apart); fewer words are one sequence. Two
    rows link when their sets' intersection has at least ``percent`` hundredths of their union. Null and empty texts
    have empty sets and link with nothing; equal sets link; a null key never becomes an id. ``key`` is an integer
    column; other columns are not read.

    Method: a sketch ranks n-grams by frequency; each set's prefix holds its rarest ones. Sets with the same size and
    prefix are one group (named by 64 bits: a shared name only adds comparisons). Groups that share a prefix n-gram and pass the length and positional filters meet at a hub,
    the first of them; groups are expanded to their distinct sets, which are compared exactly at their hub, in blocks
    where a hub is large. A task keeps a forest of the links it finds, never all pairs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key), F.col(text))
    bytes_ = rows.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    rank_bits = sketch.bits_for(bytes_ / 6, 14, RANK_BITS, 1 / 8)
    ranks = spark.sparkContext.broadcast(sketch.ranks(rows.select(text), _all_grams(text, n), rank_bits))
    sets = cut_lineage(_described(rows, key, text, n, percent, ranks, rank_bits))
    groups = sets.where("n > 0").groupBy("n", "p").agg(F.first("prefix").alias("prefix"))
    postings = groups.select("n", "p", "prefix").mapInArrow(_postings, "gram long, n long, at int, p long")
    spread = postings.repartition("gram").sortWithinPartitions("gram", "n", "p")
    stars = spread.mapInArrow(_stars(percent), _PAIR).distinct()
    narrow = sets.where("n > 0").select("n", "p", "s1", "s2").distinct()
    crowded = narrow.groupBy("p").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("p", F.col("p").alias("q"))
    hubs = cut_lineage(stars.union(crowded).union(stars.select("p", F.col("p").alias("q"))).distinct())
    member = narrow.select(F.col("p").alias("q"), "s1", "s2", "n")
    places = cut_lineage(hubs.join(member, "q").select("p", "s1", "s2", "n").distinct())
    total = places.groupBy("p").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).cast("int").alias("blocks"))
    placed = places.join(total, "p").withColumn("own", F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    tasks = placed.select("p", "s1", "s2", F.col("own"), F.explode(others).alias("_b")).select(
        "p", "s1", "s2", F.col("_b.i").alias("i"), F.col("_b.j").alias("j"), (F.col("own") != F.col("_b.i")).cast("int").alias("side"))
    need = places.select("s1", "s2").distinct()
    bits = sketch.bits_for(need.count(), 14, max_filter_bits, 16)
    wanted = spark.sparkContext.broadcast(sketch.present(need, lambda b: [b.column(0).to_numpy().view(np.uint64) ^ b.column(1).to_numpy().view(np.uint64)], bits))
    full = rows.select(text).mapInArrow(_wanted_sets(text, n, wanted, bits), "s1 long, s2 long, grams binary")
    if tasks.count() > NEAR:
        ready = tasks.join(full.dropDuplicates(["s1", "s2"]), ["s1", "s2"])
    else:  # copies in other tasks come along; a hub takes each set once
        ready = full.join(F.broadcast(tasks), ["s1", "s2"])
    ready = ready.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")
    found = ready.mapInArrow(_linked(percent), "a1 long, a2 long, b1 long, b2 long")
    node = lambda a, b: F.struct(F.col(a).alias("s1"), F.col(b).alias("s2"))
    roots = graph.components(found.select(node("a1", "a2").alias("a"), node("b1", "b2").alias("b")))
    roots = roots.select(F.col("node.s1").alias("s1"), F.col("node.s2").alias("s2"), F.col("root.s1").alias("r1"), F.col("root.s2").alias("r2"))
    own = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("least"))
    own = own.join(roots, ["s1", "s2"], "left").select("s1", "s2", "least", F.coalesce("r1", "s1").alias("r1"), F.coalesce("r2", "s2").alias("r2"))
    best = own.groupBy("r1", "r2").agg(F.min("least").alias("component_id"))
    ids = own.join(best, ["r1", "r2"]).select("s1", "s2", "component_id")
    out = sets.select("id", "n", "s1", "s2").join(ids, ["s1", "s2"], "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _all_grams(text: str, n: int):
    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, buf, off in W.text_slices(batch.column(text)):
            yield np.concatenate([*gram_sets(buf, off, n), np.zeros(0, np.uint64)])

    return keys


def _wanted_sets(text: str, n: int, wanted, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            rows = {}
            for _, _, buf, off in W.text_slices(batch.column(text)):
                for grams in gram_sets(buf, off, n):
                    if len(grams):
                        key = set_key(grams)
                        if key not in sent and sketch.any_repeated([wanted.value], np.array([key[0] ^ key[1]], np.int64).view(np.uint64), bits)[0]:
                            rows[key] = grams.tobytes()
                            sent.add(key)
            if len(sent) > 1 << 20:
                sent.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in rows], pa.int64()), pa.array([k[1] for k in rows], pa.int64()), pa.array(rows.values(), pa.binary())], ["s1", "s2", "grams"])

    return run
