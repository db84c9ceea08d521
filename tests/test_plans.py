import json

from pyspark.sql import functions as F

from spoolwise.plans import cards, validate


def minimal(**over):
    p = {"version": "1", "source": {"path": "a.mp4"}, "output": {"dir": "out"}, "clips": [{"id": "c1", "takeaway": "t", "segments": [{"start": 0, "end": 1}]}]}
    return {**p, **over}


def clip(**over):
    return [{"id": "c1", "takeaway": "t", "segments": [{"start": 0, "end": 1}], **over}]


def reel(**over):
    return {"dir": "o", "reel": over}


SAMPLES = {
    validate.CLIP_ID: ("part-7", "Part 7"), validate.REEL_FILE: ("week.mp4", "week.avi"), "^https?://": ("http://a.example/x", "ftp://a.example/x"), r"\.py$": ("lib/fade.py", "lib/fade.rb"),
}
# What the contract says across fields: a change to the full plan below, and the rule it breaks.
ACROSS = [
    (("output", "reel", "intro"), lambda n: {"title": "Hello", "image": "p.png", "qr": "http://a.example/x"}, "image_or_qr"),
    (("clips", 0, "segments", 0), lambda n: {"start": 5, "end": 5}, "segment_order"), (("clips", 0, "layout"), lambda n: {"kind": "pip"}, "pip_screen"),
    (("clips", 0, "id"), lambda n: "lpt3", "reserved_id"), (("output", "reel", "transition"), lambda n: {"kind": "cut", "module": "lib/fade.py"}, "transition_module"),
    (("output", "reel", "transition"), lambda n: {"kind": "module"}, "transition_module"), (("source", "captions"), lambda n: {"kind": "srt"}, "srt_path"),
    (("clips",), lambda n: n + n, "duplicate_id"), (("source", "duration_seconds"), lambda n: 0.5, "past_end"),
]


def sample(f):
    """A value that a field allows, and (value, rule) pairs one step outside each of its limits."""
    if f.node or f.item:
        inner = full(f.node) if f.node else sample(f.item)[0]
        if f.kind == "object":
            return inner, [("text", "type")]
        many = lambda k: [inner] * k
        bad = [({}, "type")] + ([(many(f.min_items - 1), "items")] if f.min_items else []) + ([(many(f.max_items + 1), "items")] if f.max_items else [])
        return many(max(1, f.min_items or 0)), bad
    if f.kind == "flag":
        return True, [("yes", "type"), (1, "type")]
    if f.kind == "text":
        good = f.choices[0] if f.choices else SAMPLES[f.pattern][0] if f.pattern else "v" * (f.min_length or 1)
        bad = [(5, "type")] + ([("other", "choice")] if f.choices else []) + ([(SAMPLES[f.pattern][1], "pattern")] if f.pattern else [])
        bad += [("v" * (f.min_length - 1), "length")] if f.min_length else []
        return good, bad + ([("v" * (f.max_length + 1), "length")] if f.max_length else [])
    if f.choices:
        return f.choices[0], [("x", "type"), (f.choices[0] + 1, "choice")]
    least = f.low if f.low is not None else f.above + 1 if f.above is not None else 0
    bad = [("x", "type"), ([], "type")] + ([(least + 0.5, "type")] if f.kind == "whole" else [])
    bad += [(f.low - 1, "range")] if f.low is not None else [(f.above, "range")] if f.above is not None else []
    return least, bad + ([(f.high + 1, "range")] if f.high is not None else [])


def full(node):
    """A plan, or a part of it, with every field that can stand beside the others."""
    made = {n: sample(f)[0] for n, f in node.fields.items()}
    if {"image", "qr"} <= set(made):
        del made["qr"]
    if {"kind", "module"} <= set(made):
        del made["module"]
    return made


def whole_plan():
    p = full(validate.PLAN)
    p["source"]["duration_seconds"] = 90
    return p


def changed(plan, path, edit):
    plan = json.loads(json.dumps(plan))
    at = plan
    for step in path[:-1]:
        at = at[step]
    at[path[-1]] = edit(at.get(path[-1]) if isinstance(at, dict) else at[path[-1]])
    return plan


def faulty(node, path=()):
    """(path, edit, rule) for every field of the contract: missing, of another type, outside each limit, unknown."""
    yield (*path, "zz"), lambda n: 1, "unknown_key"
    for name, f in node.fields.items():
        here = (*path, name)
        if f.required:
            yield path, lambda n, name=name: {k: v for k, v in n.items() if k != name}, "required"
        for value, rule in sample(f)[1]:
            yield here, lambda n, value=value: value, rule
        if f.node:
            yield from faulty(f.node, here if f.kind == "object" else (*here, 0))
        elif f.item:
            for value, rule in sample(f.item)[1]:
                yield (*here, 0), lambda n, value=value: value, rule


def test_contract(spark):
    good = [whole_plan(), minimal(), minimal(output=reel(transition={"kind": "module", "module": "lib/fade.py"}, outro={"title": "By", "qr": "https://a.example"}))]
    cases = [c for c in [*faulty(validate.PLAN), *ACROSS] if c[0] or c[2] == "required"]
    plan = {"root": whole_plan()}
    broken = [(changed(plan, ("root", *path), edit)["root"], rule) for path, edit, rule in cases]
    assert len(broken) > 150
    rows = [(-1 - n, json.dumps(p)) for n, p in enumerate(good)] + [(n, json.dumps(p)) for n, (p, _) in enumerate(broken)] + [(9999, '{"version": Infinity}'), (9998, "[]")]
    d = spark.createDataFrame(rows, "plan_id long, plan_json string")
    hit = {}
    for r in validate.violations(d).collect():
        hit.setdefault(r.plan_id, set()).add(r.rule)
    assert not [k for k in hit if k < 0] and hit[9999] == hit[9998] == {"json"}
    missed = [(path, rule, hit.get(n)) for n, (path, _, rule) in enumerate(cases) if rule not in hit.get(n, set())]
    assert not missed


def test_story(spark):
    specs = [("ok", {"start": 0, "end": 30, "cards": [{"title": "a"}], "overlays": [{"start": 1, "end": 2, "text": "x"}], "layout": "full"}),
             ("out", {"start": 0, "end": 30, "overlays": [{"start": 40, "end": 41, "text": "x"}]}), ("corner", {"start": 0, "end": 30, "layout": {"kind": "pip", "screen": [0, 0, 1, 1], "corner": "middle"}})]
    d = spark.createDataFrame([(n, json.dumps(s)) for n, s in specs], "spec_id string, record string")
    assert {r.spec_id for r in validate.validate_story(d).collect()} == {"out", "corner"}


def test_settings(spark):
    rows = [("ok", '{"title": "T", "transition": {"kind": "dip", "seconds": 0.4}}'), ("key", '{"titel": "T"}'), ("long", json.dumps({"title": "x" * 81})), ("tr", '{"transition": "wipe"}')]
    d = spark.createDataFrame(rows, "k string, settings_json string")
    assert {r.k for r in validate.validate_settings(d, "k").collect()} == {"key", "long", "tr"}


def test_card_runs_and_timeline(spark):
    clips = [{"id": f"clip-0{n}", "takeaway": "t", "segments": [{"start": a, "end": b}], "card": {"title": "c", "seconds": 3}} for n, (a, b) in enumerate([(100, 136.05), (200, 222.85)], 1)]
    out = reel(intro={"title": "i", "seconds": 4}, opening=[{"title": "o", "seconds": 7}], chapter_cards="all", closing=[{"title": "z", "seconds": 7}], outro={"title": "e", "seconds": 6}, transition={"kind": "dip", "seconds": 0.4})
    docs = [("dip", minimal(clips=clips, output=out)), ("dissolve", minimal(clips=clips, output=reel(**{**out["reel"], "transition": {"kind": "dissolve", "seconds": 0.5}})))]
    d = cards.parsed(spark.createDataFrame([(n, json.dumps(p)) for n, p in docs], "plan_id string, plan_json string"))
    runs = {}
    for r in cards.card_runs(d, 24).orderBy("plan_id", "run_ix").collect():
        runs.setdefault(r.plan_id, []).append((r.start_frame, r.frames, r.position))
    assert runs["dip"] == [(0, 336, "first"), (336 + 865, 72, "middle"), (336 + 865 + 72 + 548, 312, "last")]
    assert runs["dissolve"][0] == (0, 336 - 24, "first")
    roles = [r.role for r in cards.timeline(d).where("plan_id = 'dip'").orderBy("item_ix").collect()]
    assert roles == ["intro", "opening", "chapter", "clip", "chapter", "clip", "closing", "outro"]
    total = d.select("plan_id", cards.plan_runtime(F.col("plan")).alias("s")).first().s
    assert abs(total - (4 + 7 + 3 + 36.05 + 3 + 22.85 + 7 + 6)) < 1e-6
