"""Filter audit, importance resampling and exact search against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolwise.llm import filter_audit, pivots, resample

from . import brute
from .test_operators import TEXTS


def audit_plain(rows, labels):
    """Every order walked document by document."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    least = {}
    for k, text, _ in rows:
        if k is not None:
            least[text or ""] = min(k, least.get(text or "", k))
    fails = []
    for k, text, part in rows:
        t, w = text or "", brute.words(text)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
             "D": any(c in "#$%&*|" for c in t), "E": k is not None and least[t] < k}
        fails.append((part or "", {n for n, x in f.items() if x}, k in good, k in toxic))
    out, taken = {}, Counter()
    for p in permutations("ABCDE"):
        for part in {x[0] for x in fails}:
            stay = [x for x in fails if x[0] == part]
            for step, own in enumerate(p, 1):
                gone = [x for x in stay if own in x[1]]
                stay = [x for x in stay if own not in x[1]]
                failing = [x for x in fails if x[0] == part and own in x[1]]
                taken[part, own] += len(gone)
                out[part, "".join(p), step] = [len(stay), len(gone), len(failing) - len(gone), sum(x[1] == {own} for x in failing),
                                               sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {k: (*v, taken[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    rng = random.Random(5)
    texts = [*TEXTS, " ".join(f"w{i}" for i in range(250)), " ".join("ab cd" for _ in range(150)), "LOUD " * 3, "x" * 100_000]
    rows = [(i, t, rng.choice(["a", "b", None])) for i, t in enumerate(texts)]
    rows += [(rng.randrange(400, 900), rng.choice(texts), rng.choice("ab")) for _ in range(60)]
    rows += [(-3, texts[0], "b"), (-3, texts[0], "a"), (-3, texts[0], "a"), (-9, texts[3], "b"), (None, texts[0], "a"), (None, None, "b"), (7, texts[1], "a")]
    return rows


@pytest.mark.parametrize("files", [1, 6])
def test_filter_audit(spark, tmp_path, files):
    rows = audit_rows()
    rng = random.Random(files)
    rng.shuffle(rows)  # smaller ids come late, so that earlier batches are taken back
    clash = [F.lit(1).alias(c) for c in ("mask", "part", "n", "digest", "good", "_words", "id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *clash)
    docs.repartition(files, F.rand(3)).write.parquet(str(tmp_path / "docs"))
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 300, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stream, rules = filter_audit.contract_filters(filter_audit.document_stream(spark, str(tmp_path / "docs")))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
           for r in filter_audit.audit(stream, told, rules).collect()}
    assert got == audit_plain(rows, labels)


def test_filter_audit_retracts(spark, tmp_path):
    """The counters after each batch are those of the documents so far."""
    text = " ".join(f"w{i}" for i in range(250))
    for n, k in enumerate((9, 5, 7, 2)):
        spark.createDataFrame([(k, text, "a")], "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    stream, rules = filter_audit.contract_filters(filter_audit.document_stream(spark, str(tmp_path / "docs"), batches=4))
    counters = filter_audit.copy_counters(stream, spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int"), rules)
    assert {(r["mask"], r["good"]): r["n"] for r in counters.collect()} == {(0, True): 1, (16, False): 3}


def test_filter_audit_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "docs"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    stream, rules = filter_audit.contract_filters(filter_audit.document_stream(spark, str(tmp_path / "docs")))
    assert filter_audit.audit(stream, none, rules).collect() == []


def features(text, most=3):
    w = brute.alnum(text)
    return [" ".join(w[i:i + k]) for i in range(len(w)) for k in range(1, most + 1) if i + k <= len(w)]


def resample_plain(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([x for _, x in rows], target))
    size, goal = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(float((t[b] + 1) * (size + 10000)) / float((s[b] + 1) * (goal + 10000)))) for b in s}
    out = []
    for k, x in rows:
        f = features(x)
        weight = sum(gain[bucket(y)] for y in f)
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(brute.alnum(x))])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for n, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_resample(spark):
    texts = [*TEXTS, "w" * 70 + " " + "é" * 90 + " " + "z" * 300_000 + " end", *[t for t in TEXTS if t and len(t) > 200] * 4]
    rows = [*enumerate(texts), (None, TEXTS[5]), (3, TEXTS[3]), (3, TEXTS[3])]
    target = [TEXTS[0], TEXTS[7], None, ""]
    clash = [F.lit(1).alias(c) for c in ("key", "buckets", "rank", "_tie", "_part", "n_words", "weight")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *clash).repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string").withColumn("_none", F.lit("x"))
    got = resample.resample(docs, goal).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == resample_plain(rows, target)


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).collect() == []
    got = resample.resample(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), none).collect()
    assert {r["doc_id"]: (r["n_features"], r["rank"]) for r in got} == {1: (3, None), 2: (0, None)}


def test_checksums():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 3000, 300)
    end = start + rng.choice([0, 1, 5, 63, 64, 65, 1900], 300)
    crc = resample.span_crcs(buf, start, end)
    assert crc.tolist() == [zlib.crc32(buf[a:b].tobytes()) for a, b in zip(start, end)]
    joined = resample.shifted(crc, (end - start)[::-1]) ^ crc[::-1]
    assert joined.tolist() == [zlib.crc32(buf[c:d].tobytes(), zlib.crc32(buf[a:b].tobytes())) for a, b, c, d in zip(start, end, start[::-1], end[::-1])]


def search_plain(rows, k=5):
    whole = [(n, i, [math.floor(256.0 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows)
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in whole:
        if i % 50 == 0:
            best = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, m) for m, j, w in whole if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, j, _) in enumerate(best, 1)]
    return sorted(out)


def vectors(seed, n, dims, few):
    """Clusters, a vector that a third of the rows share, zeros, and rows that can't take part."""
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=(5, dims))
    rows = [(int(i), [float(np.float32(x)) for x in (np.zeros(dims) if i % 40 == 3 else heart[0] if i % 3 == 0 else heart[i % 5] + rng.normal(size=dims) * few)]) for i in range(n)]
    bad = [(100, None), (150, [1.0, None] * (dims // 2)), (200, [float("nan")] * dims), (250, [float("inf")] * dims), (None, [1.0] * dims), (50, rows[7][1]), (9, [])]
    return rows + bad


@pytest.mark.parametrize("seed, n, dims, rounds", [(1, 400, 8, (1, 2, None)), (2, 300, 2, (2, None)), (3, 120, 16, (None,))])
def test_search(spark, monkeypatch, seed, n, dims, rounds):
    monkeypatch.setattr(pivots, "RING_ROWS", 8)
    monkeypatch.setattr(pivots, "BLOCK", 16)
    monkeypatch.setattr(pivots, "PACK", 3)
    rows = vectors(seed, n, dims, 0.1)
    clash = [F.lit(1).alias(c) for c in ("id", "row", "vec", "ask", "_row", "rank")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *clash).coalesce(1)
    assert sorted(map(tuple, pivots.search(df, rounds=rounds).collect())) == search_plain(rows)


def test_search_stops_early(spark, monkeypatch):
    """Rings beyond the bound of every query are never compared."""
    monkeypatch.setattr(pivots, "RING_ROWS", 8)
    seen = []
    inner = pivots._wanted
    monkeypatch.setattr(pivots, "_wanted", lambda *a: (lambda w: (seen.append(w.count()), w)[1])(inner(*a)))
    rng = np.random.default_rng(4)
    heart = rng.normal(size=(40, 24))
    heart /= np.linalg.norm(heart, axis=1)[:, None]
    rows = [(i, [float(np.float32(x)) for x in heart[i % 40] + rng.normal(size=24) * 0.002]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, pivots.search(df).collect())) == search_plain(rows)
    assert sum(seen) < 0.5 * 16 * 20


def test_search_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    assert pivots.search(spark.createDataFrame([], kind)).collect() == []
    assert pivots.search(spark.createDataFrame([(0, None)], kind)).collect() == []
    assert pivots.search(spark.createDataFrame([(0, [1.0])], kind)).collect() == []
    rows = [(0, [1.0, 2.0]), (50, [3e30, -1.0]), (7, [-3e30, 2.0])]
    got = sorted(map(tuple, pivots.search(spark.createDataFrame(rows, kind)).collect()))
    assert [r[:3] for r in got] == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)] and got[3][3] == -(2**63)


def test_search_sends_no_lists_to_the_driver(spark, monkeypatch):
    """The lists of queries for all rings are no broadcast, and of the sample's candidates the driver gets a few times SAMPLE."""
    monkeypatch.setattr(pivots, "RING_ROWS", 8)
    monkeypatch.setattr(pivots, "SAMPLE", 20)
    plans, sent, inner, whole = [], [], pivots._compared, type(spark.range(0)).limit
    monkeypatch.setattr(pivots, "_compared", lambda *a: (lambda c: (plans.append(c._jdf.queryExecution().toString()), c)[1])(inner(*a)))
    monkeypatch.setattr(type(spark.range(0)), "limit", lambda df, n: (sent.append(df.count()), whole(df, n))[1])
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, pivots.search(df).collect())) == search_plain(rows)
    assert plans and all("SortMergeJoin [ring" in p and "BroadcastHashJoin [ring" not in p for p in plans)
    assert 20 <= max(sent) < 100
