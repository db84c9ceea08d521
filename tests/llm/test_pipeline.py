"""The pipeline's stages against plain versions, each on its own input."""

import random

import corpus_pipeline
from spoolwise.llm import quality

from . import brute


def plain(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "in", "re", "ti"]) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "", ".\n"]) for _ in range(n)) + " end"


def tables(spark, path):
    rng = random.Random(12)
    texts = [plain(rng, rng.randint(40, 120)) for _ in range(80)]
    texts += [texts[3], texts[4], texts[5] + " more", "  ".join(texts[6].split(" "))]
    texts += [" ".join(w + "&&&" for w in plain(rng, 60).split()) for _ in range(8)]
    item = " ".join(plain(rng, 30).split())
    texts += [plain(rng, 50) + " " + item, "too short", None, "", "x y z " * 40]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int("&&&" not in (t or "")), 0) for i, t in enumerate(texts) if i % 2 or i > 83], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return item


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    item = tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        own = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/stage{n}")
        out = spark.read.parquet(f"{path}/stage{n}")
        got = {r["doc_id"]: r for r in out.collect()}
        if n < 4:
            assert out.columns == columns
        if name == "quality_rules":
            model = quality.fit_quality(docs, spark.read.parquet(f"{path}/labels.parquet"))
            assert model.forest is not None
            for i, t in own.items():
                c = brute.counts(t)
                failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
                assert (i in got) == (not failed and "&&&" not in t), i
        elif name == "line_dedup":
            kept = brute.kept_lines(list(own.items()))
            want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k in kept[i]) for i, t in own.items()}
            assert {i: r["text"] for i, r in got.items()} == {i: t for i, t in want.items() if brute.words(t)}
            assert not {80, 81} & set(got)
        elif name == "ngram_jaccard":
            assert set(got) == {k for k, _, least in brute.classes(sorted(own.items()), 5, 80) if k == least}
        elif name == "decontamination":
            hits = dict(zip(own, brute.contamination(own.values(), [(1, item)])))
            assert set(got) == {i for i in own if not hits[i][1]} and len(got) == len(own) - 1
        else:
            assert set(got) == set(own) and all(r["same_text"] and r["n_pieces"] == len(r["ids"]) for r in got.values())
        docs = out
    ran = corpus_pipeline.run(spark, path)
    assert {r["doc_id"]: r["ids"] for r in ran.collect()} == {i: r["ids"] for i, r in got.items()}
