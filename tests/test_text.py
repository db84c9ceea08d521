from pyspark.sql import functions as F

from spoolwise.functions import clock as ck, text as tx


def test_clean_text(apply):
    got = apply(["So, um, real quick", "often. Uh, but yes", "one - two", "a well-known .exe ,", "you know, I like it"], tx.clean_text)
    assert got == ["So, real quick", "often. but yes", "one two", "a well-known .exe", "I it"]


def test_tidy_sentence_drops_unpaired_quotes(apply):
    got = apply(['bots do the work." And I asked, "Is it right?', 'he said "yes" twice', '"open', 'plain'], tx.tidy_sentence)
    assert got == ["Bots do the work. And I asked, Is it right?", 'He said "yes" twice', "Open", "Plain"]


def test_clip_text(apply):
    assert apply(["short", "a" * 50, "word " * 20], lambda t: tx.clip_text(t, 40)) == [
        "short", "a" * 39 + "…", "word word word word word word word…",
    ]


def test_teachable_and_decisions(apply):
    got = apply(["because the trick is 5 minutes", "hold on, can you hear me", "plain words"], tx.teachable)
    assert got == [2.5, -3.0, 0.0]


def test_keywords_and_hits(apply):
    assert sorted(apply(["Make a clip about questioning the agents"], tx.keywords)[0]) == ["agent", "agents", "question", "questioning"]
    got = apply(["question questions quest", "nothing"], lambda t: tx.keyword_hits(t, tx.keywords(F.lit("question"))))
    assert got == [2, 0]


DANGLING = [
    ("It writes the plan. And the cool thing is...", True), ("It writes the plan for you.", False), ("And the cool thing is.", True),
    ("Here's the thing.", True), ("I don't know what the real reason was.", False), ("and it gives you the.", True),
    ("That's what it's for.", False), ("What it is.", False), ("You know what?", True), ("Is it right?", False),
    ("Let me just find the tab.", True), ("Hold on to your hats.", False), ("Hold on.", True), ("We use three tools:", True),
]


def test_dangling(apply):
    got = apply([t for t, _ in DANGLING], tx.dangling)
    assert [g is not None for g in got] == [d for _, d in DANGLING]
    assert got[0] == "cool thing is..." or got[0].endswith("cool thing is...")


def test_best_sentence_and_quote(apply):
    kws = tx.keywords(F.lit("agents"))
    assert apply(["First part. Agents write code. The end"], lambda t: tx.best_sentence_for(t, kws)) == ["Agents write code."]
    words = " ".join(str(n) for n in range(100))
    got = apply([words, "a b"], lambda t: tx.quote(F.split(t, " ")))
    assert got[1] == "a b" and len(got[0].split()) == 89 and got[0].split()[70] == "…" and got[0].endswith("98 99")


def test_trim_words(apply):
    f = lambda a, b: lambda t: tx.trim_words(t, F.lit(a), F.lit(b))
    assert apply(["one two three four", "(Ann)\nhello there my friend\n-"], f(0.5, 1.0)) == ["three four", "(Ann)\nmy friend\n-"]
    assert apply(["one two\n(Bob)\nthree four"], f(0.0, 0.5)) == ["one two"]
    assert apply(["(Ann)\n-"], f(0.0, 0.1)) == ["(Ann)\n-"]


def test_clocks(apply):
    assert apply(["1:02:03.5", "02:03", "7", "-0:10", "x", "1:2:3:4"], ck.parse_clock) == [3723.5, 123.0, 7.0, -10.0, None, None]
    n = lambda t: t.cast("double")
    assert apply(["3725.9", "59"], lambda t: ck.clock(n(t))) == ["1:02:05", "0:00:59"]
    assert apply(["3725.9", "59"], lambda t: ck.ts(n(t))) == ["1:02:05", "0:59"]
    assert apply(["3661.2345"], lambda t: ck.srt_time(n(t))) == ["01:01:01,234"]
    assert apply(["Hello, World!", "!!"], ck.slug) == ["hello-world", "clip"]
    assert apply(["0.5", "36.05", "0.001"], lambda t: ck.frame_count(n(t), 24)) == [12, 865, 1]
