"""Exact top-k search by inner product over a pivot-distance index.

Vectors get one more coordinate that gives all of them the same norm M. Between a query (whose own extra coordinate is 0)
and a vector then stand only two things, the inner product and the distance, and one decides the other:
``d^2 = |q|^2 + M^2 - 2 score``. The best scores are the nearest vectors, and the triangle inequality holds.

Every vector is keyed by its nearest pivot and its distance from it. The key space is cut into rings (annuli) around
the pivots; a ring whose distances lie in [lo, hi] can't hold anything nearer to a query than
``max(d(q, pivot) - hi, lo - d(q, pivot))``. A query looks into the rings of least bound first, and stops at the first
round in which no ring's bound is within the distance of its k-th best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.scans import cut_lineage
from .words import free_names

SAMPLE = 4096
"""Vectors to which the pivots are fitted; any pivots give the same results."""
PIVOTS, RINGS = 256, 64
"""Most pivots, and most rings of a pivot: the directory of rings has at most their product in rows."""
RING_ROWS = 1024
BLOCK = 1024
"""Vectors in a block: a ring of more has several."""
PACK = 256
"""Queries that are compared with a block at once."""
SEND = 32
"""Rings whose queries are written in one batch: at most ``SEND`` x ``PACK`` vectors."""
ROUNDS: tuple[int | None, ...] = (2, 8, None)
"""Rings that a query has looked into after each round; in the last one all that are left within its bound."""
_LOW = -(1 << 63)


def _matrix(packed: pa.Array | bytes, dims: int) -> np.ndarray:
    raw = packed if isinstance(packed, bytes) else b"".join(packed.to_pylist())
    return np.frombuffer(raw, np.int64).reshape(-1, dims)


def _narrow(v: np.ndarray) -> np.ndarray:
    """The same whole numbers in the fewest bytes that hold all of them."""
    kinds = (k for k in (np.int16, np.int32) if not v.size or (v.min() >= np.iinfo(k).min and v.max() <= np.iinfo(k).max))
    return v.astype(next(kinds, np.int64))


def _wide(packed: bytes, n: int, dims: int) -> np.ndarray:
    """``n`` vectors as ``_narrow`` has left them, as longs."""
    return np.frombuffer(packed, {2: np.int16, 4: np.int32, 8: np.int64}[len(packed) // (n * dims)]).reshape(n, dims).astype(np.int64)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond the range of a long they stop at its ends."""
    high = lambda x: int(np.abs(x.astype(np.float64)).max()) if x.size else 0
    most = high(a) * high(b) * max(1, a.shape[1])
    if most < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


@dataclass
class Index:
    """Pivots in the space with one more coordinate, and the directory of rings (number, least and greatest distance)."""

    pivots: np.ndarray
    norm2: float
    rings: int
    ring: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @property
    def slack(self) -> float:
        """More than rounding can add to a distance."""
        return 1e-6 * (1.0 + np.sqrt(self.norm2))

    def distances(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        v = vectors.astype(np.float64)
        own = (v * v).sum(1)
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.norm2 - own, 0))
        flat, last = self.pivots[:, :-1], self.pivots[:, -1]
        d2 = (own + extra * extra)[:, None] + (self.pivots * self.pivots).sum(1)[None] - 2 * (v @ flat.T + extra[:, None] * last[None])
        return np.sqrt(np.maximum(d2, 0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and ring the distance below which the ring holds nothing."""
        d = self.distances(queries, True)[:, self.ring // self.rings]
        return np.maximum(np.maximum(d - self.high, self.low - d), 0) - self.slack


def whole_vectors(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``df``'s other columns with ``id`` and ``vec``, each component times ``scale`` and rounded down; rows of which that
    can't be said are left out."""
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rest = [c for c in df.columns if c not in (key, vector)]
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & good).select(F.col(key).alias("id"), whole.alias("vec"), *rest)


def _pack(df: DataFrame, dims: int) -> DataFrame:
    """``vec`` as packed longs, shorter vectors with zeros behind."""
    names = [f for f in df.schema.fields if f.name != "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            size = np.diff(vec.offsets.to_numpy())
            out = np.zeros((len(batch), dims), np.int64)
            out[np.repeat(np.arange(len(batch)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = vec.flatten().to_numpy()
            rows = [r.tobytes() for r in out]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in names], pa.array(rows, pa.binary())], names=[*[f.name for f in names], "vec"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", vec binary")


def _least_hashes(distinct: DataFrame) -> DataFrame:
    """The ``SAMPLE`` vectors of least hash. Hashes are spread evenly, so those below a cut are some more than that in all;
    without the cut each task would send as many to the driver."""
    share = min(1.0, 2 * SAMPLE / max(1, distinct.count()))
    cut = int(share * 2.0**64) - (1 << 63) if share < 1 else (1 << 63) - 1
    return distinct.withColumn("_hash", F.xxhash64("vec")).where(F.col("_hash") <= cut).orderBy("_hash", "vec").limit(SAMPLE).select("vec")


def fit_index(reps: DataFrame, dims: int, rows: int) -> Index:
    """Pivots by a few rounds of k-means over the ``SAMPLE`` distinct vectors of least hash; ``first`` marks one row of each."""
    count = int(np.clip(round((rows / RING_ROWS) ** 0.5 * 2), 1, PIVOTS))
    rings = int(np.clip(round(rows / (RING_ROWS * count)), 1, RINGS))
    norm2 = reps.agg(F.max("norm2")).first()[0] or 0.0
    sample = _least_hashes(reps.where("first").select("vec")).collect()
    v = np.concatenate([_matrix(bytes(r["vec"]), dims) for r in sample]).astype(np.float64) if sample else np.zeros((1, dims))
    v = np.column_stack((v, np.sqrt(np.maximum(norm2 - (v * v).sum(1), 0))))
    at = v[np.linspace(0, len(v) - 1, min(count, len(v))).astype(int)]
    for _ in range(8):
        near = ((v * v).sum(1)[:, None] + (at * at).sum(1)[None] - 2 * v @ at.T).argmin(1)
        at = np.stack([v[near == n].mean(0) if (near == n).any() else at[n] for n in range(len(at))])
    return Index(at, float(norm2), rings)


def _keyed(reps: DataFrame, index: Index, dims: int) -> DataFrame:
    """``reps`` with the nearest ``pivot`` and the distance ``near`` from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = index.distances(_matrix(batch.column("vec"), dims), False)
            pivot = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "row", "vec")], pa.array(pivot), pa.array(d[np.arange(len(d)), pivot])], names=["id", "row", "vec", "pivot", "near"])

    kind = reps.schema["id"].dataType.simpleString()
    return reps.select("id", "row", "vec").mapInArrow(run, f"id {kind}, row long, vec binary, pivot long, near double")


def _ringed(keyed: DataFrame, index: Index) -> DataFrame:
    """``keyed`` with ``ring``: rings of equal width between each pivot's least and greatest distance (at most ``PIVOTS``
    rows are read)."""
    low, width = [0.0] * len(index.pivots), [1.0] * len(index.pivots)
    for r in keyed.groupBy("pivot").agg(F.min("near").alias("lo"), F.max("near").alias("hi")).collect():
        low[r["pivot"]], width[r["pivot"]] = r["lo"], max((r["hi"] - r["lo"]) / index.rings, 1e-9)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("pivot") + 1).cast("int"))
    place = F.least(F.floor((F.col("near") - pick(low)) / pick(width)), F.lit(index.rings - 1).cast("long"))
    return keyed.withColumn("ring", F.col("pivot") * index.rings + F.greatest(place, F.lit(0).cast("long")))


def _blocks(keyed: DataFrame, dims: int) -> DataFrame:
    """Blocks of at most ``BLOCK`` vectors of one ring in order of distance; a large ring is dealt to several tasks."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(n, "ring", "near", "row").sortWithinPartitions("ring", "near", "row")
    kind = keyed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            # least ids first, so that of equal scores the first places have the least ids
            t = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()
            held.clear()
            one = lambda c, k: pa.array([t.column(c).to_pylist()], pa.list_(k))
            vecs = _narrow(_matrix(t.column("vec"), dims)).tobytes()
            return pa.RecordBatch.from_arrays(
                [t.column("ring").slice(0, 1).combine_chunks(), one("id", t.schema.field("id").type), one("row", pa.int64()), pa.array([vecs], pa.binary())],
                names=["ring", "ids", "rows", "vecs"])

        for batch in batches:
            ring = batch.column("ring").to_numpy()
            cut = [0, *(np.flatnonzero(ring[1:] != ring[:-1]) + 1).tolist(), len(ring)]
            for a, b in zip(cut[:-1], cut[1:]):
                while a < b:
                    if held and (held[0].column("ring")[0].as_py() != ring[a] or sum(map(len, held)) >= BLOCK):
                        yield flush()
                    take = min(b - a, BLOCK - sum(map(len, held)))
                    held.append(batch.slice(a, take))
                    a += take
        if held:
            yield flush()

    return dealt.mapInArrow(run, f"ring long, ids array<{kind}>, rows array<long>, vecs binary")


def _wanted(open_: DataFrame, index: Index, seen: int, upto: int | None, dims: int) -> DataFrame:
    """(ring, query, vec, least) for the rings that the queries look into in this round: those at places ``seen`` to
    ``upto`` in order of their bounds, if the bound is within the distance of the query's k-th best score ``least``. A row
    holds up to ``PACK`` queries that look into its ring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PACK):
                part = batch.slice(at, PACK)
                q = _matrix(part.column("vec"), dims)
                bound = index.bounds(q)
                order = np.argsort(bound, axis=1, kind="stable")[:, seen:upto]
                least = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                reach = np.sqrt(np.maximum((q.astype(np.float64) ** 2).sum(1) + index.norm2 - 2 * least, 0)) + index.slack
                reach[least <= float(_LOW)] = np.inf
                row, place = np.nonzero(np.take_along_axis(bound, order, 1) <= reach[:, None])
                ring = index.ring[order[row, place]]
                by = np.argsort(ring, kind="stable")
                row, ring, small = row[by], ring[by], _narrow(q)
                head = np.flatnonzero(np.diff(ring, prepend=ring[:1] - 1))
                cut = np.append(head, len(ring))
                for n in range(0, len(head), SEND):
                    to = cut[n : n + SEND + 1]
                    pick, offsets = pa.array(row[to[0] : to[-1]]), pa.array(to - to[0], pa.int32())
                    listed = lambda c: pa.ListArray.from_arrays(offsets, part.column(c).take(pick))
                    vecs = [small[row[a:b]].tobytes() for a, b in zip(to[:-1], to[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ring[to[:-1]]), listed("query"), pa.array(vecs, pa.binary()), listed("least")], names=["ring", "query", "vec", "least"])

    return open_.select("query", "vec", "least").mapInArrow(run, "ring long, query array<long>, vec binary, least array<long>")


def _compared(blocks: DataFrame, wanted: DataFrame, k: int, dims: int) -> DataFrame:
    """Of each query and block the ``k`` best (score, id, row) that reach the query's ``least``.

    The queries of all rings are many times the table of queries by which Spark would judge them, so the join is told
    to sort and merge: as a broadcast they would all pass through the driver.
    """
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    pairs = blocks.join(wanted.hint("merge"), "ring").select("ids", "rows", "vecs", "query", "vec", "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                one = lambda c: batch.column(c)[n].values
                ids, rows, query, least = one("ids"), one("rows").to_numpy(), one("query").to_numpy(), one("least").to_numpy()
                wide = lambda c, m: _wide(batch.column(c)[n].as_py(), m, dims)
                score = inner(wide("vec", len(query)), wide("vecs", len(rows)))
                hit = score >= least[:, None]
                many = np.flatnonzero(hit.sum(1) > k)  # only there a block has more to offer than k places
                best = np.argsort(-np.maximum(score[many], np.iinfo(np.int64).min + 1), axis=1, kind="stable")[:, :k]
                hit[many] = False
                hit[many[:, None], best] = True
                q, at = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array(query[q]), pa.array(score[q, at]), ids.take(pa.array(at)), pa.array(rows[at])], names=["query", "score", "id", "row"])

    return pairs.mapInArrow(run, f"query long, score long, id {kind}, row long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """``query`` and its ``k`` best, the best first; Spark trims each map task before the shuffle."""
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def search(
    vectors: DataFrame, k: int = 5, asks: Column | None = None, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
    rounds: tuple[int | None, ...] = ROUNDS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` best other rows for each row that ``asks`` is true of.

    Components are multiplied by ``scale`` and rounded down; a score is the inner product of these whole numbers. Ties go
    to the smaller key, then to the row that comes first in the table as read. Rows without a key, or whose vector is null or
    holds a null or a non-finite component, take no part; a shorter vector counts as one with zeros behind, an empty one
    has score 0 with all. Rows that share a key are rows of their own: each asks, and each is found by the others. Scores
    beyond the range of a long stop at its ends. An empty table gives no rows. Other columns are not looked at.

    Equal vectors score alike with everything, so of each distinct vector only the ``k`` + 1 least keys can be among the
    ``k`` best of any row: these are indexed, and each distinct vector asks once for ``k`` + 1.
    """
    asks = F.col(key) % 50 == 0 if asks is None else asks
    ask, row = free_names([key, vector], "_ask", "_row")
    numbered = vectors.select(F.col(key), F.col(vector), F.coalesce(asks, F.lit(False)).alias(ask), F.monotonically_increasing_id().alias(row))
    whole = whole_vectors(numbered, key, vector, scale).select("id", "vec", F.col(ask).alias("ask"), F.col(row).alias("row"))
    whole = whole.withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    whole = cut_lineage(whole)
    dims = whole.agg(F.max(F.size("vec"))).first()[0]
    if dims is None:
        kind = vectors.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    dims = max(dims, 1)
    packed = cut_lineage(_pack(whole, dims))
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id", "row"))
    reps = packed.withColumn("_place", place).where(F.col("_place") <= k + 1)
    reps = cut_lineage(reps.select("id", "row", "vec", "norm2", (F.col("_place") == 1).alias("first")))
    index = fit_index(reps, dims, packed.count())
    keyed = cut_lineage(_ringed(cut_lineage(_keyed(reps, index, dims)), index))
    directory = keyed.groupBy("ring").agg(F.min("near").alias("lo"), F.max("near").alias("hi")).orderBy("ring").collect()
    index.ring = np.array([r["ring"] for r in directory])
    index.low, index.high = np.array([r["lo"] for r in directory]), np.array([r["hi"] for r in directory])
    blocks = cut_lineage(_blocks(keyed, dims))
    queries = cut_lineage(packed.where("ask").groupBy("vec").agg(F.min("row").alias("query")))
    parts = min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-queries.count() // PACK)))
    open_, best, seen = queries.withColumn("least", F.lit(_LOW)), None, 0
    for upto in rounds:
        found = _compared(blocks, _wanted(open_.repartition(parts, "query"), index, seen, upto, dims), k + 1, dims)
        best = cut_lineage(_best(found if best is None else best.unionByName(found), k + 1))
        if upto is None or upto >= len(index.ring):
            break
        kth = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") > k)
        open_, seen = queries.join(kth, "query", "left").select("query", "vec", F.coalesce("least", F.lit(_LOW)).alias("least")), upto
    item = F.struct(F.bitwise_not("score").alias("back"), "id", "row", "score")
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(item)).alias("found")).join(queries, "query").select("vec", "found")
    others = F.slice(F.filter("found", lambda f: f["row"] != F.col("row")), 1, k)
    asked = packed.where("ask").select("id", "row", "vec").join(lists, "vec").select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "f"))
    return asked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))
