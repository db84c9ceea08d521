"""Running values against a plain walk, and what their plans read."""

import random

from pyspark.sql import functions as F

from spoolwise.operators import scans as sc, transcript as tr

SCHEMA = "recording_id long, ix long, v long"


def rows_of(rng):
    out = []
    for key in (None, 1, 2, 3):
        for ix in range(rng.randrange(1, 60)):
            out.append((key, ix, rng.choice([None, rng.randrange(-9, 30)])))
    return out


def plain(rows):
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        vs = [r[2] for r in own]
        known = lambda part: [v for v in part if v is not None]
        for n, r in enumerate(own):
            past, future = known(vs[:n]), known(vs[n + 1:])
            want[key, r[1]] = (
                sum(known(vs[: n + 1])), past[-1] if past else None, (known(vs[: n + 1]) or [None])[-1], future[0] if future else None,
                (known(vs[n:]) or [None])[0], max(past, default=None), min(future, default=None),
            )
    return want


def test_scan_equals_a_walk(spark):
    rng = random.Random(3)
    for size in (1, 7, 1000):
        rows = rows_of(rng)
        df = spark.createDataFrame(rows, SCHEMA)
        v = F.col("v")
        got = sc.scan(
            df, ["recording_id"], ["ix"], sc.by_index("ix", size), t=sc.total(F.coalesce(v, F.lit(0))), b=sc.before(v), u=sc.upto(v), a=sc.after(v),
            o=sc.onward(v), p=sc.peak_before(v), l=sc.low_after(v),
        )
        assert got.columns == ["recording_id", "ix", "v", *"tbuaopl"]
        want = plain(rows)
        told = {(r["recording_id"], r["ix"]): tuple(r[c] for c in "tbuaopl") for r in got.collect()}
        if size == 1000:
            assert told == want
        else:  # rows without a recording meet no other chunk
            assert {k: x for k, x in told.items() if k[0] is not None} == {k: x for k, x in want.items() if k[0] is not None}
        assert len(told) == len(rows)


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sc.scan(df, ["recording_id"], ["ix"], sc.by_index("ix"), t=sc.total(F.col("v"))).collect() == []


def test_input_is_worked_out_once(spark, tmp_path):
    """Two scans in a row: one read of the file, one shuffle of the input for each."""
    cues = spark.range(400).select(
        (F.col("id") % 3).alias("recording_id"), F.floor(F.col("id") / 3).alias("cue_ix"), F.col("id").cast("double").alias("start"),
        F.lit("It was said. And then").alias("text"), F.lit("A").alias("speaker"),
    )
    cues.write.parquet(f"{tmp_path}/cues")
    for names in (["recording_id", "sent_ix", "text"], ["recording_id", "sent_ix", "start", "text", "speaker"]):
        got = tr.sentences(spark.read.parquet(f"{tmp_path}/cues")).select(*names)
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 2
        assert plan.count("REPARTITION_BY_COL, [plan_id") == 4  # each named again by the one that reuses it


def test_values_ahead_take_one_pass(spark):
    """No frame is open towards the end: such a frame is walked again for each row. Rows that tie keep one order both ways."""
    rows = [(1, ix, v) for ix in range(300) for v in (ix, None, ix + 1000)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    v = F.col("v")
    got = sc.scan(df, ["recording_id"], ["ix"], sc.by_index("ix"), t=sc.total(F.lit(1)), a=sc.after(v), o=sc.onward(v), l=sc.low_after(v))
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
    told = sorted((r["t"], r["v"], r["a"], r["o"], r["l"]) for r in got.collect())
    vs = [x[1] for x in told]
    assert [x[0] for x in told] == [*range(1, 901)]
    for n, (_, v, a, o, low) in enumerate(told):
        later = [x for x in vs[n + 1:] if x is not None]
        assert (a, low) == (later[0] if later else None, min(later, default=None)) and o == (a if v is None else v)
