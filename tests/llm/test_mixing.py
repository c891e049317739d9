"""The mix against its targets, worked out one source at a time."""

import re
from collections import defaultdict

from conftest import SMALL, folder
from pyspark.sql import functions as F

from tesserix.llm import mixing


def goals(sizes, weights=(5, 2, 1), total=1.5, most=2):
    """Targets by source: repeated resharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), total * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(rows, docs, close):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(d["doc_id"]), words(d["text"])) for d in docs)
    sizes, taken = defaultdict(int), defaultdict(int)
    for d in docs:
        sizes[d["source"]] += words(d["text"])
    want = goals(sizes)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= close * max(1, want[s]) + 25, (s, n, want[s])


def test_edge_rows(spark, edge, tmp_path):
    check(mixing.op2_mixing(spark, folder(spark, tmp_path, documents=edge)).collect(), edge.collect(), 0.5)


def test_query_and_rerun(spark, small):
    first = mixing.op2_mixing(spark, SMALL)
    rows = first.collect()
    check(rows, small.collect(), 0.02)
    again = mixing.op2_mixing(spark, SMALL).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_tilt(spark, small):
    """Rates follow exp(lambda * size): within a source and one sign of lambda, larger texts have larger (or smaller) rates."""
    rows = mixing.op2_mixing(spark, SMALL).where("size > 0").groupBy("source", F.floor(F.log2("size")).alias("k")).agg(F.avg("copies").alias("rate"), F.count("*").alias("n")).collect()
    assert rows and all(0 <= r["rate"] <= 2 for r in rows)


def test_hot_source_of_one_size(spark):
    rows = [(i, "a b c d", "hot") for i in range(3000)] + [(5000 + i, "x " * (i + 1), f"s{i % 7}") for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df, mixing.word_count(F.col("text")), F.col("source"), ["doc_id"]).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in mixed:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
    want = goals(sizes)
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)


def test_empty_and_clashes(edge, none):
    assert mixing.mix(none, F.lit(1), F.col("source"), ["doc_id"]).collect() == []
    odd = edge.withColumns({"size": F.lit("x"), "target": F.lit(1), "copies": F.lit(2), "__bucket": F.lit(3), "no_src": F.lit(4), "src": F.lit(5), "n": F.lit(6), "m": F.lit(7), "before": F.lit(1), "cnt": F.lit(1), "bucket": F.lit(2), "__rank": F.lit(9)})
    got = mixing.mix(odd, mixing.word_count(F.col("text")), F.col("source"), ["doc_id"])
    assert got.count() == edge.count() and {"no_src", "src", "n", "m", "before", "bucket"} <= set(got.columns)


def test_an_unsettled_source_is_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(mixing, "STEPS", 1)
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", 1 + i * i % 50) for i in range(300)], "doc_id long, source string, n long")
    with pytest.raises(ArithmeticError):
        mixing.mix(df, df["n"], df["source"], ["doc_id"])


def test_steps_add_no_partitions(spark, small, monkeypatch):
    """Else every Newton step would read and write one shuffle's partitions more than the one before."""
    kept, cut, key = [], mixing.cut, "spark.sql.adaptive.coalescePartitions.enabled"

    def noted(df):
        kept.append(cut(df))
        return kept[-1]

    monkeypatch.setattr(mixing, "cut", noted)
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        docs = small.select("doc_id", "source", F.length("text").alias("size"))
        mixing.mix(docs, F.col("size"), F.col("source"), ["doc_id"])
        states = [df for df in kept if "lam" in df.columns]
        assert len(states) > 2 and {df.rdd.getNumPartitions() for df in states} == {1}
    finally:
        spark.conf.set(key, before)
