"""The automaton against edit distance; held-out accuracy; edge cases."""

import math
import random

from conftest import SMALL, folder
from pyspark.sql import functions as F

from tesserix.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton():
    rng, words = random.Random(1), ["scum", "worthless", "idiot", "abcab"]
    auto = toxicity.Automaton(words, ["disgus"])
    for _ in range(3000):
        w = list(rng.choice([*words, "disgusting", "zzz"]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "a", "x"])
        token = "".join(w)
        near = any(distance(token, v) <= 1 for v in words if len(v) >= toxicity.FUZZY)
        want = 1 if token in words else 2 if token.startswith("disgus") else 3 if near else 0
        assert auto.match(token) == want, token


def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{where}/labels.parquet")
    got = toxicity.op1_toxicity(spark, where).where("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == (r["toxic"] > 0) for r in got)
    assert right >= 0.93 * len(got) and sum(r["predicted"] for r in got if not r["toxic"]) <= 0.03 * len(got)


def test_labels_of_held_out_rows_teach_nothing(spark, small, tmp_path):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.op1_toxicity(spark, SMALL).collect()
    b = toxicity.op1_toxicity(spark, folder(spark, tmp_path, documents=small, labels=turned)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_edge_rows(spark, edge, none, tmp_path):
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.op1_toxicity(spark, folder(spark, tmp_path, documents=edge, labels=labels)).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
    nothing = toxicity.op1_toxicity(spark, folder(spark, tmp_path / "none", documents=none, labels=labels.limit(0)))
    assert nothing.collect() == []


def test_quotation():
    model = toxicity.Model(["scum"], [], [1.0] * toxicity.FEATURES, 0.0)
    read = toxicity.Reader(model).features
    assert read("you are scum")[0] > 0 and read("you are scum")[4] == 0
    assert read('he said "you are scum" to me')[0] == 0 and read('he said "you are scum" to me')[4] > 0


def test_scores_follow_texts_alone(spark):
    df = spark.createDataFrame([(1, "a scum b", "x"), (2, "a scum b", "y"), (3, None, "z"), (4, "", "q")], "score long, text string, hits string")
    got = [r["score"] for r in toxicity.score(df, toxicity.Model(["scum"], [], [1.0] * toxicity.FEATURES, -1.0)).collect()]
    assert got[0] == got[1] > got[2] == got[3]


def test_learning_bounds_batches(spark):
    """Fitting sends texts to Python before anything is scored."""
    from tesserix.llm.common import BATCH

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(k, "you scum" if k < 5 else f"fine day {k}") for k in range(10)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 5)) for k in range(10)], "doc_id long, toxic int")
    try:
        spark.conf.set(key, "64m")
        toxicity.fit(docs, labels)
        assert spark.conf.get(key) == str(BATCH)
    finally:
        spark.conf.set(key, before)


def test_words_beside_their_stems():
    auto = toxicity.Automaton(["disgusting", "trash"], ["disgusti", "trash"])
    assert [auto.match(t) for t in ("disgusting", "disgustingly", "disgxsting", "disgstingg", "trash", "trashy", "trxsh", "tras", "tra")] == [1, 2, 3, 0, 1, 2, 3, 3, 0]


def test_misspelt_words_count(spark):
    """Toxic rows of which a part has nothing but one-edit variants, none of them often enough to be learned."""
    rng, bad = random.Random(2), ["disgusting", "worthless", "pathetic", "idiots", "clown", "trash", "moron", "loser"]
    plain = [f"{a}{b}{c}" for a in ("bar", "len", "mos", "tir") for b in ("an", "el", "io", "ur") for c in ("do", "ka", "pem", "va")]

    def variant(w):
        at = rng.randrange(1, 4)
        return w[:at] + rng.choice("qxz") + w[at + rng.randrange(2) :]

    def text(kind):
        words = rng.choices(plain, k=30)
        for at in rng.sample(range(30), 3) if kind else []:
            words[at] = rng.choice(bad) if kind == "toxic" else variant(rng.choice(bad))
        return " ".join(words)

    kinds = ["toxic", "misspelt", "", "", "", ""] * 100
    rows = [(i, text(k), int(bool(k)), i >= 400, k) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, unseen boolean, kind string")
    model = toxicity.fit(df, df.where("not unseen").select("doc_id", "toxic"))
    assert set(bad) <= set(model.words)
    got = toxicity.score(df.where("unseen"), model).collect()
    assert all((r["score"] >= toxicity.THRESHOLD) == (r["toxic"] > 0) for r in got)
    assert all(r["hits"][2] > 0 for r in got if r["kind"] == "misspelt")


def naive_score(text, model):
    """The score by definition: edit distances instead of the automaton, positions one by one."""
    text = text.lower()
    found = list(toxicity.TOKEN.finditer(text))

    def kind(t):
        if t in model.words:
            return 1
        if any(t.startswith(s) for s in model.stems):
            return 2
        near = any(len(w) >= toxicity.FUZZY and abs(len(w) - len(t)) < 2 and distance(t, w) <= 1 for w in model.words)
        return 3 if near else 0

    kinds = [kind(m.group()) for m in found]
    count, quoted, at = [0] * 4, 0, []
    for i, (m, k) in enumerate(zip(found, kinds, strict=True)):
        if k:
            before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 60]
            framed = any(c in toxicity.QUOTES for c in before) and any(c in toxicity.QUOTES for c in after)
            if framed and (any(x.group() in toxicity.SAID for x in found[max(0, i - 6) : i]) or before.count('"') % 2):
                quoted += 1
            else:
                count[k] += 1
                at.append(i)
    dense = max((sum(a <= b < a + toxicity.WINDOW for b in at) for a in at), default=0)
    x = [math.log1p(n) for n in count[1:]] + [float(count[1] + count[2] > 0), math.log1p(quoted), math.log1p(dense), len(at) / max(1, len(found))]
    x = x if any(kinds) else [0.0] * len(x)
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model.weights, strict=True)) + model.bias)))


def test_query_against_definition(spark, small):
    model = toxicity.fitted(spark, SMALL)
    texts = {r["doc_id"]: r["text"] or "" for r in small.collect()}
    got = toxicity.op1_toxicity(spark, SMALL).collect()
    assert len(got) == len(texts) and model.words
    for r in got:
        want = naive_score(texts[r["doc_id"]], model)
        assert math.isclose(r["score"], want, abs_tol=1e-9) and r["predicted"] == (r["score"] >= 0.3), r


def test_very_long_and_tied_texts(spark):
    long = "plain words here " * 200_000 + "you scum"
    df = spark.createDataFrame([(1, long), (2, "x" * 2_000_000), (3, "scum"), (3, "scum")], "doc_id long, text string")
    got = [r["score"] for r in toxicity.score(df, toxicity.Model(["scum"], [], [1.0] * toxicity.FEATURES, -1.0)).collect()]
    assert got[0] > got[1] and got[2] == got[3] > got[0]
