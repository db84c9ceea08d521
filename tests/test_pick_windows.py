import re

import pytest
from pyspark.sql import functions as F

from spoolwise.functions import text as tx
from spoolwise.functions.lexicon import ENGLISH
from spoolwise.operators import picks as pk, transcript as tr

SAID = ["We measured the cache", "and it works. Then", "latency fell by half!", "", "Why does the index grow?", "Because keys repeat.", "So we merge the runs"]


@pytest.fixture()
def cues(spark):
    rows = [(r, n, n * 4.0, n * 4.0 + 3.5, SAID[(n * (r + 2)) % 7] + (f" part{n}" if n % 3 else ""), ["ann", "bob", None][n // 5 % 3]) for r in range(3) for n in range(40 - 15 * r)]
    return spark.createDataFrame(rows, "recording_id long, cue_ix int, start double, end double, text string, speaker string")


@pytest.fixture()
def windows(spark):
    rows = [(r, i * 2 + kind, i, i + size, 0, i * 4.0, 9.0, 1.0, kind, 3.0) for r in range(2) for i in range(0, 20) for kind, size in ((0, i % 5), (1, 5 + i % 2 * 13)) if r == 0 or i + size < 25]
    return spark.createDataFrame(rows, "recording_id long, cand_ix int, i int, last int, bucket int, start double, end double, score double, kind int, short double")


@pytest.mark.parametrize("part", [1, 4, 64])
def test_words_of_windows(monkeypatch, cues, windows, part):
    """Windows within one part and over many have the words of all their cues."""
    monkeypatch.setattr(pk, "PART", part)
    met = windows.select("recording_id", "cand_ix", F.explode(F.sequence("i", "last")).alias("cue_ix")).join(cues, ["recording_id", "cue_ix"])
    words = met.groupBy("recording_id", "cand_ix").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(tx.content_set(F.col("text")))))).alias("w"))
    said = tr.best_sentence(met, ("recording_id", "cand_ix")).select("recording_id", "cand_ix", F.filter(tx.tokens(F.col("text")), lambda t: ~t.isin(*ENGLISH.stop_words)).alias("s"))
    want = {(r[0], r[1]): (r["w"], list(dict.fromkeys(r["s"] or []))) for r in words.join(said, ["recording_id", "cand_ix"], "left").collect()}
    got = pk._with_words(windows, cues, ENGLISH).collect()
    assert len(got) == len(want) == windows.count()
    assert {(r["recording_id"], r["i"] * 2 + r["kind"]): (sorted(r["words"]), r["said"]) for r in got} == want


def test_cues_of_windows_are_not_shuffled_for_each_window(spark, cues, windows):
    """All shuffles above the join of windows and cues would carry a row for each cue of each window."""
    plan = pk._with_words(windows, cues, ENGLISH)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    dealt = [re.sub(r"#\d+L?|, \d+$", "", d) for d in dealt]
    assert dealt and not any("cand_ix" in d or "_chunk" in d for d in dealt)
