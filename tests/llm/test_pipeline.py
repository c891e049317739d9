"""The pipeline's stages on small tables."""

import random
import re
from collections import Counter

import corpus_pipeline
from conftest import SMALL, folder

from tesserix.llm import linededup, minhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_run(spark, small):
    docs, sf = small, SMALL
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, sf).collect(), small.schema)
        assert docs.columns == small.columns and 0 < docs.count() <= 2 * before.count(), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    mine = Counter(r["doc_id"] for r in docs.collect())
    starts = Counter(r["doc_id"] for r in packed if r["start"] == 0)
    assert mine == starts


def test_stages_take_effect(spark, small):
    clean = corpus_pipeline.drop_toxic(spark, small, SMALL)
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.op1_toxicity(spark, SMALL).collect()}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, p in scored.items() if not p)
    lines = corpus_pipeline.drop_boilerplate(spark, small, SMALL)
    want = {r["doc_id"]: r["text"] for r in linededup.op3_line_dedup(spark, SMALL).collect()}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want
    single = corpus_pipeline.drop_near_copies(spark, small, SMALL)
    kept = [r["doc_id"] for r in minhash.op6_minhash(spark, SMALL).where("kept").collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(kept)


def test_edge_rows(spark, edge, none, tmp_path):
    labels = spark.createDataFrame([(4, 0), (5, 0)], "doc_id long, toxic int")
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, documents=edge, labels=labels)).count() > 0
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "none", documents=none, labels=labels)).count() == 0


def test_near_copies_from_80_hundredths(spark, small):
    """The stage against all pairs at 0.8, on documents and on pairs of every similarity about it."""
    rng, rows = random.Random(8), [(r["doc_id"], r["text"]) for r in small.collect()]
    for g in range(60):
        words = [f"g{g}w{k}" for k in range(204)]
        rows.append((10_000 + 2 * g, " ".join(words)))
        for at in rng.sample(range(5, 199, 5), 2 + g % 5):
            words[at] = f"n{g}_{at}"
        rows.append((10_001 + 2 * g, " ".join(words)))
    sets = [(d, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))) for d, t in rows for w in [WORD.findall(t.translate(LOW))] if w]
    top = {d: d for d, _ in rows}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    between = 0
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if 100 * len(x & y) >= 80 * len(x | y):
                between += 100 * len(x & y) < 85 * len(x | y)
                low, high = sorted((find(a), find(b)))
                top[high] = low
    df = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], small.schema)
    stage = dict(corpus_pipeline.STAGES)["MinHash near-dedup"]
    assert between > 10
    assert sorted(r["doc_id"] for r in stage(spark, df, SMALL).collect()) == sorted(d for d in top if find(d) == d)


def test_repeated_passages_of_any_length(spark, small):
    """Lines of 40 to 200 words on 12 sources go, those on 9 stay."""
    rows = []
    for n in (40, 50, 51, 60, 200):
        for i in range(12):
            often, rare = " ".join([f"p{n}"] * n), " ".join([f"r{n}"] * n)
            rows.append((n * 100 + i, f"{often}\n{rare if i < 9 else 'x'}\nown {n} {i}", "en", f"s{i}", 1))
    df = spark.createDataFrame(rows, small.schema)
    got = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, df, SMALL).collect()}
    assert got == {d: "\n".join(t.split("\n")[1:]) for d, t, *_ in rows}


def test_near_copies_without_ids(spark):
    """Those without ids go for one that has an id, and one of each text stays; clashing columns don't matter."""
    from pyspark.sql import functions as F

    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, words), (None, words), (None, words + " more"), (None, other), (None, other), (None, other.upper()), (None, None), (None, ""), (None, ""), (7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gone": F.lit(1), "node": F.lit("n"), "kept": F.lit(False), "__key": F.lit(0)})
    out = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(got) == 6 and (5, words) in got and (7, "x") in got and got.count((None, "")) == 2 and (None, None) in got
