"""The hash tree's law, its slots and its movement."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from conftest import SMALL, folder
from pyspark.sql import functions as F

from tesserix.llm import sharding


def check(rows, docs, shards=16):
    want = sorted([(str(d["doc_id"]), len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs])
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    slots, by_key = defaultdict(list), {}
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], shards) and 0 <= r["shard"] < shards and r["law"] == "key"
        assert by_key.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))


def test_edge_rows(spark, edge, none, tmp_path):
    check(sharding.op10_sharding(spark, folder(spark, tmp_path, documents=edge)).collect(), edge.collect())
    assert sharding.op10_sharding(spark, folder(spark, tmp_path / "none", documents=none)).collect() == []


def test_query(spark, small):
    check(sharding.op10_sharding(spark, SMALL).collect(), small.collect())


def test_shares_follow_weights(spark):
    df = spark.range(40_000).select(F.col("id").alias("k"))
    tree = [[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 4.0)]]]
    n = {r["shard"]: r["count"] for r in df.select(sharding.descend([F.col("k")], tree).alias("shard")).groupBy("shard").count().collect()}
    for s, w in ((0, 1), (1, 3), (2, 2), (3, 4)):
        assert abs(n[s] - 4000 * w) < 300


def test_movement_stays_in_the_changed_subtree(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"))
    old = [[[(0, 1.0), (1, 1.0)], [(2, 1.0), (3, 1.0)]], [[(4, 1.0), (5, 1.0)]]]
    new = [[[(0, 1.0), (1, 1.0)], [(2, 1.0), (3, 3.0)]], [[(4, 1.0), (5, 1.0)]]]
    moved = df.select(sharding.descend([F.col("k")], old).alias("a"), sharding.descend([F.col("k")], new).alias("b")).where("a <> b").groupBy("a", "b").count().collect()
    # rows enter the region whose weight grew; those that were in it go to its grown rack, and there to its grown shard
    into = {0: {2, 3}, 1: {2, 3}, 2: {3}, 3: set(), 4: {0, 1, 2, 3}, 5: {0, 1, 2, 3}}
    assert moved and all(r["b"] in into[r["a"]] for r in moved)


def test_growth_takes_rows_only_into_the_new_shard(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"))
    for n in (1, 7, 8, 16, 21):
        tree = sharding.topology(n)
        got = df.select(sharding.descend([F.col("k")], tree).alias("a"), sharding.descend([F.col("k")], sharding.grow(tree)).alias("b")).groupBy("a", "b").count().collect()
        assert all(r["b"] in (r["a"], n) for r in got)
        share = sum(r["count"] for r in got if r["b"] == n) / 20_000
        assert abs(share - 1 / (n + 1)) < 0.02
        assert len(Counter(r["a"] for r in got)) == n


def test_clashes(edge):
    odd = edge.withColumns({"__bucket": F.lit(1), "slot": F.lit("x"), "shard": F.lit(0), "__before": F.lit(3)})
    got = sharding.shard_rows(odd, ["doc_id"], sharding.topology(4))
    assert got.count() == edge.count() and {"__bucket", "__before"} <= set(got.columns)


def walk(key, node, label=""):
    """The leaf that a long key comes to, draw by draw, with the hash computed outside Spark."""
    if isinstance(node, tuple):
        return node[0]

    def drawn(name, weight):
        h = xxhash.xxh64(name.encode(), seed=xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()).intdigest()
        return math.log(((h >> 11) + 0.5) / 2**53) / weight

    names = [f"s{x[0]}" if isinstance(x, tuple) else f"{label}/{i}" for i, x in enumerate(node)]
    won = max(range(len(node)), key=lambda i: drawn(names[i], sharding.weight_of(node[i])))
    return walk(key, node[won], names[won])


def test_query_against_a_walk(spark):
    tree = sharding.topology(16)
    for r in sharding.op10_sharding(spark, SMALL).collect():
        assert (r["shard"], r["grown_shard"]) == (walk(r["doc_id"], tree), walk(r["doc_id"], sharding.grow(tree)))


def test_uneven_tree_against_a_walk(spark):
    tree = [[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 4.0), (4, 0.5)]], [[(5, 2.0)]]]
    for r in spark.range(2000).select("id", sharding.descend([F.col("id")], tree).alias("shard")).collect():
        assert r["shard"] == walk(r["id"], tree)


def test_slots_of_equal_keys_agree(spark):
    rows = [(7, f"text {i}") for i in range(50)]
    one = lambda rows: {r["text"]: r["slot"] for r in sharding.shard_rows(spark.createDataFrame(rows, "k long, text string").repartition(3), ["k"], sharding.topology(4)).collect()}
    assert one(rows) == one(rows[::-1])
