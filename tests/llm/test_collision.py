"""Nearest neighbours: exact scores, order and recall against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, folder
from pyspark.sql import functions as F

from tesserix.llm import collision

SCHEMA = "vec_id long, embedding array<float>, label int"


def check(got, rows, least, k=20):
    sound = {}
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            sound[r["vec_id"]] = np.array(v, float)
    ids = np.array(sorted(sound))
    x = np.array([sound[i] for i in ids])
    by, hits, total = {}, 0, 0
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {i for i in sound if i % 20 == 0}
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        score = x @ sound[q]
        score[ids == q] = -np.inf
        assert [r["rank"] for r in own] == list(range(1, min(k, len(ids) - 1) + 1))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        for r in own:
            assert abs(r["score"] - sound[r["vec_id"]] @ sound[q]) < 1e-9 and r["vec_id"] != q
        best = np.lexsort((ids, -score))[: len(own)]
        hits += len({int(ids[b]) for b in best} & {r["vec_id"] for r in own})
        total += len(own)
    assert hits >= least * total


def test_query(spark):
    check(collision.op9_ann(spark, SMALL).collect(), spark.read.parquet(f"{SMALL}/embeddings.parquet").collect(), 0.9)


def test_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(collision, "VECTORS", 700)
    monkeypatch.setattr(collision, "QUERIES", 40)
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.standard_normal(32).astype(np.float32)], 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(collision.op9_ann(spark, folder(spark, tmp_path, embeddings=df)).collect(), df.collect(), 0.9)


def test_edge_rows(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 2.0], 1), (3, [1.0, 1.0], 1), (4, [1.0, 1.0], 1), (5, None, 1), (6, [0.0, 0.0], 1), (40, [None, 1.0], 1), (7, [float("nan"), 1.0], 1), (60, [float("inf"), 1.0], 1), (None, [1.0, 2.0], 1), (80, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(collision.op9_ann(spark, folder(spark, tmp_path, embeddings=df)).collect(), df.collect(), 1.0)
    assert collision.op9_ann(spark, folder(spark, tmp_path / "none", embeddings=df.limit(0))).collect() == []


@pytest.mark.parametrize("kind", ["unit", "wide", "small", "large", "clustered", "outlier", "skewed"])
def test_recall_at_any_norm(kind):
    """Whole blocks: scaled, clustered and skewed norms, and one vector much longer than the rest."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((collision.VECTORS, 128 if kind == "wide" else 64))
    if kind == "clustered":
        x = rng.standard_normal((200, 64))[rng.integers(0, 200, len(x))] + 0.5 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= {"small": 0.1, "large": 30.0, "clustered": 0.1}.get(kind, 1.0)
    if kind == "outlier":
        x[5] *= 10
    if kind == "skewed":
        x *= rng.lognormal(0, 0.7, len(x))[:, None]
    ids, asked = np.arange(len(x)), np.arange(0, len(x), len(x) // 60)
    side = lambda at: pa.table({"id": ids[at], "v": pa.array(list(x[at]), pa.list_(pa.float64()))})
    got = collision.search_block(20)(side(asked), side(ids)).to_pylist()
    hits = 0
    for q in asked.tolist():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    print(kind, hits / (20 * len(asked)))
    assert hits >= 0.95 * 20 * len(asked)


def test_ties_and_repeated_rows(spark, tmp_path, monkeypatch):
    """Equal vectors in several blocks come by id; rows of one id count once."""
    monkeypatch.setattr(collision, "VECTORS", 100)
    rng = np.random.default_rng(5)
    kinds = rng.standard_normal((12, 9))
    rows = [(i, [float(c) for c in kinds[i * 7 % 12].astype(np.float32)]) for i in range(500)]
    df = spark.createDataFrame([*rows, *rows[:50]], "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit("x"), "rank": F.lit(2), "d": F.lit(None)})
    check(collision.op9_ann(spark, folder(spark, tmp_path, embeddings=df)).collect(), df.collect(), 1.0)
    twice = spark.createDataFrame([(0, [2.0]), (0, [1.0]), (1, [1.0]), (1, [-3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in collision.op9_ann(spark, folder(spark, tmp_path / "twice", embeddings=twice)).collect()] == [(0, 1, 1, -3.0)]


def test_equal_vectors_in_a_block_are_exact_ties():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((40, 17))[rng.integers(0, 40, 800)]
    ids = np.arange(len(x))
    side = pa.table({"id": ids, "v": pa.array(list(x), pa.list_(pa.float64()))})
    got = collision.search_block(20)(side, side).to_pylist()
    for q in range(len(x)):
        own = [r for r in got if r["query_id"] == q]
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        same = np.flatnonzero((x == x[own[0]["vec_id"]]).all(axis=1))
        assert own[0]["vec_id"] == min(i for i in same.tolist() if i != q)


def test_recall_on_the_driver_s_vectors(spark):
    where = "/root/testdata/sf0.1"
    check(collision.op9_ann(spark, where).collect(), spark.read.parquet(f"{where}/embeddings.parquet").collect(), 0.95)
