"""The reel's rounds against a plain walk through the same rule, on random windows."""

import random

from spoolwise.operators import picks as pk


def plain(windows, minutes, k):
    """Indexes of the windows of one recording, by the rule as stated in ``_reel_rounds``."""
    low, high = minutes * 60 * (1 - pk.TOLERANCE), minutes * 60 * (1 + pk.TOLERANCE)
    n = range(len(windows))
    size = lambda x: windows[x]["end"] - windows[x]["start"]
    total = lambda have: pk.INTRO + pk.BOOKENDS + sum(pk.CARD + pk.AIR + size(x) for x in have)
    strength = lambda x: (-windows[x]["score"], windows[x]["i"], windows[x]["kind"])

    def near(x, y, field, limit):
        a, b = set(windows[x][field]), set(windows[y][field])
        return bool(a | b) and len(a & b) / len(a | b) > limit and (field == "words" or bool(a and b))

    def says(x, have):
        return any(near(x, y, "words", 0.5) or near(x, y, "said", 0.6) for y in have)

    def free(have, repeats=True):
        apart = [x for x in n if all(windows[x]["end"] <= windows[y]["start"] or windows[y]["end"] <= windows[x]["start"] for y in have)]
        return [x for x in apart if not (repeats and says(x, have))]

    have = []
    for b in range(k):
        own = [x for x in free(have, False) if windows[x]["bucket"] == b]
        have += sorted(own, key=strength)[:1]
    best = []
    for x in sorted(have, key=lambda x: (-windows[x]["score"], have.index(x))):
        best += [] if says(x, best) else [x]
    have = best

    def fill(have):
        while total(have) < low and (open_ := free(have)):
            room = high - total(have)
            have = [*have, min(open_, key=lambda x: (pk.CARD + size(x) > room, *strength(x)))]
        return have

    have = fill(have)
    for x in sorted(have, key=lambda x: (windows[x]["score"], have.index(x))):
        if total(have) > high and len(have) > pk.MIN_MOMENTS:
            have = [y for y in have if y != x]
    while total(have) > high:
        shorter = {x: min((y for y in n if windows[y]["i"] == windows[x]["i"]), key=lambda y: (size(y), windows[y]["kind"])) for x in have}
        long = [x for x in have if size(shorter[x]) < size(x)]
        if not long:
            break
        x = max(long, key=lambda x: (size(x), -windows[x]["i"]))
        have = fill([shorter[y] if y == x else y for y in have])
    while len(have) < pk.MIN_MOMENTS and (open_ := free(have)):
        have.append(min(open_, key=lambda x: (round(size(x)), *strength(x))))
    return {(windows[x]["i"], windows[x]["kind"]) for x in have}


def recording(rng, cues, words, k):
    out, t = [], 0
    for i in range(cues):
        t += rng.randint(3, 9)
        span = rng.sample(range(12, 40), 2)
        for kind in range(rng.randint(1, 2)):
            said = [f"s{rng.randrange(words)}" for _ in range(rng.randint(0, 3))]
            out.append({"i": i, "kind": kind, "start": float(t), "end": float(t + span[kind]), "score": rng.randrange(300) / 100, "last": i + 2,
                        "words": list({f"w{rng.randrange(words)}" for _ in range(6)}), "said": list(set(said))})
    for w in out:
        w["short"] = min(x["end"] - x["start"] for x in out if x["i"] == w["i"])
        w["bucket"] = int(w["start"] / (t + 40) * k)
    return out


def test_rounds_follow_the_rule(spark):
    rng = random.Random(6)
    for minutes, k in ((1.0, 2), (4.0, 5), (0.5, 2)):
        made = {r: recording(rng, rng.choice([2, 5, 30, 90]), rng.choice([8, 20, 60]), k) for r in range(14)}
        rows = [(r, *[w[c] for c in ("bucket", *pk.PICK)]) for r, ws in made.items() for w in ws]
        schema = "recording_id long, bucket int, start double, end double, score double, i int, kind int, last int, short double, words array<string>, said array<string>"
        got = {r: set() for r in made}
        for p in pk._reel_rounds(spark.createDataFrame(rows, schema), minutes, k).collect():
            got[p["recording_id"]].add((p["i"], p["kind"]))
        assert got == {r: plain(ws, minutes, k) for r, ws in made.items()}


def test_fill_looks_past_the_best_windows(spark):
    """A hundred strong windows all say the same; the weak one behind them is what a reel still needs."""
    same = ["a", "b", "c"]
    ws = [{"i": i, "kind": 0, "start": 40.0 * i, "end": 40.0 * i + 20, "score": 5 - i / 1000, "last": i, "short": 20.0, "words": same, "said": [], "bucket": 0 if i < 50 else 1} for i in range(100)]
    ws.append({**ws[0], "i": 100, "start": 4000.0, "end": 4020.0, "score": 0.1, "words": ["x"], "bucket": 1})
    rows = [(1, *[w[c] for c in ("bucket", *pk.PICK)]) for w in ws]
    schema = "recording_id long, bucket int, start double, end double, score double, i int, kind int, last int, short double, words array<string>, said array<string>"
    got = {p["i"] for p in pk._reel_rounds(spark.createDataFrame(rows, schema), 1.0, 2).collect()}
    assert got == {0, 100}


def test_terms_of_all_forms(spark):
    from spoolwise.operators import pii

    lines = spark.createDataFrame([(1, "Proj-77 and acme"), (2, "acme  Corp +++ here"), (3, None)], "id long, text string")
    terms = spark.createDataFrame([(t,) for t in [r"re:proj-\d+", "acme corp", "+++", "# note", "", *[f"re:zz{n}" for n in range(70)]]], "text string")
    got = {(r["id"], r["term"], r["match"]) for r in pii.term_hits(lines, terms, ["id"]).collect()}
    assert got == {(1, r"re:proj-\d+", "Proj-77"), (2, "acme corp", "acme  Corp"), (2, "+++", "+++")}


def test_terms_meet_by_their_rarest_word(spark):
    """Ids may repeat or be null, the rarest word need not be the longest, and letters fold as in the patterns."""
    from spoolwise.operators import pii

    rows = [(1, "frequentword alone"), (1, "frequentword of zed"), (None, "FREQUENTWORD of  Zed and frequentword of zed"), (2, "zedd frequentword of zed2"), (3, "long \u017feason"), (4, ""), (5, "5 \u212aELVIN")]
    lines = spark.createDataFrame(rows, "id long, text string")
    terms = spark.createDataFrame([("frequentword of zed",), ("no such words",), ("long season",), ("frequentword of zed",), ("5 kelvin",)], "text string")
    got = sorted((r["id"] or 0, r["term"], r["match"]) for r in pii.term_hits(lines, terms, ["id"]).collect())
    assert got == [
        (0, "frequentword of zed", "FREQUENTWORD of  Zed"), (0, "frequentword of zed", "frequentword of zed"),
        (1, "frequentword of zed", "frequentword of zed"), (3, "long season", "long \u017feason"),
        (5, "5 kelvin", "5 \u212aELVIN"),
    ]
    assert pii.term_hits(lines, terms.where("false"), ["id"]).count() == 0 == pii.term_hits(lines.where("false"), terms, ["id"]).count()


def test_covered_cells_against_a_grid(spark):
    import random

    from spoolwise.operators import pii

    rng = random.Random(5)
    boxes = [(n % 2, float(rng.randrange(12)), 12.0 + rng.randrange(6), rng.randrange(150), rng.randrange(90), rng.randrange(1, 90), rng.randrange(1, 60)) for n in range(14)]
    df = spark.createDataFrame(boxes, "recording_id long, start double, end double, x int, y int, w int, h int")
    for grid in (8, 7):
        got = pii.coverage(df, 160, 96, grid).collect()
        assert len(got) > 10
        for r in got:
            cells = {
                (i, j) for k, a, b, x, y, w, h in boxes if k == r.recording_id and a < r.end and b > r.start
                for i in range(x // grid, min(-(-160 // grid), -(-(x + w) // grid))) for j in range(y // grid, min(-(-96 // grid), -(-(y + h) // grid)))
            }
            assert abs(r.share - len(cells) / (-(-160 // grid) * -(-96 // grid))) < 1e-9


def test_overlaps_are_settled_part_by_part(spark):
    """The rule walked over each whole recording gives what its parts give."""
    import random

    rng = random.Random(11)
    rows = []
    for n in range(400):
        a = rng.randrange(0, 40_000) / 2
        rows.append((n % 3, n, a, a + rng.choice([0.0, 0.5, 1.0, 3.5, 20.0, 45.5])))
    limits = {0: 15_000.0, 1: 99_999.0}
    moments = spark.createDataFrame(rows, "recording_id long, moment_ix long, start double, end double")
    lengths = spark.createDataFrame(list(limits.items()), "recording_id long, duration_seconds double")
    want = set()
    for rid in range(3):
        reach = -1.0
        for _, n, a, b in sorted((r for r in rows if r[0] == rid), key=lambda r: (r[2], r[1])):
            last = limits.get(rid, 1e9)
            if a >= last - 1:
                continue
            b = min(b, last)
            if a < reach and b - reach < 1:
                continue
            a, reach = max(a, reach), b
            want.add((rid, n, a, b))
    kept, notes = pk.resolve_overlaps(moments, lengths)
    assert {tuple(r) for r in kept.collect()} == want and 0 < notes.count() < 400


def test_no_row_is_picked_twice(spark):
    from pyspark.sql import functions as F

    from spoolwise.operators.folds import greedy_pick

    df = spark.createDataFrame([(1, n, []) for n in range(6)], "recording_id long, n int, words array<string>")
    got = greedy_pick(df, [F.col("n")], 4, lambda p, x: F.arrays_overlap(p["words"], x["words"]), pool=2)
    assert sorted(r["n"] for r in got.collect()) == [0, 1, 2, 3]


def test_window_whose_first_word_lies_past_a_bin_edge(spark):
    rows = [(1, 0, 59.0, 80.0, "It is said.", "A", 61.0, 80.0), (2, 0, 49.0, 70.0, "It is said.", "A", 51.0, 70.0)]
    cues = spark.createDataFrame(rows, "recording_id long, cue_ix int, start double, end double, text string, speaker string, s_start double, s_end double")
    got = pk.candidate_windows(cues, 15, 60, 30.0).collect()
    assert sorted((r["recording_id"], r["start"]) for r in got) == [(1, 61.0), (2, 51.0)]
