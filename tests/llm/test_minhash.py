"""Near-duplicate groups against all pairs."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserix.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(r["doc_id"], shingle_set(r["text"])) for r in rows]
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j in range(i):
            b, y = sets[j]
            if (a is not None and a == b) or x and y and 100 * len(x & y) >= 85 * len(x | y):
                top[find(i)] = find(j)
    least = {}
    for i, (a, x) in enumerate(sets):
        if a is not None and x:
            least[find(i)] = min(least.get(find(i), a), a)
    return sorted([(a, len(x), least.get(find(i)) if x else a) for i, (a, x) in enumerate(sets)], key=str)


def result(df):
    got = minhash.components_of(df.select("doc_id", "text")).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str)


def test_edge_rows(edge):
    assert result(edge) == brute(edge.collect())


def test_documents(small):
    assert result(small) == brute(small.collect())


def test_chains_and_copies(spark):
    """Chains of small edits, groups of copies, and texts near the threshold on both sides."""
    rng, rows = random.Random(3), []
    for g in range(8):
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(90)]
        for k in range(14):
            rows.append((len(rows) * 7 % 1000, " ".join(words)))
            if k % 3:
                words = words[:]
                words[rng.randrange(90)] = f"n{rng.randrange(10**9)}"
        rows += [(2000 + g * 50 + k, " ".join(words)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(df.collect())


def test_large_buckets(spark, monkeypatch):
    """Nodes that share buckets but not links with the representatives; blocks are made small."""
    monkeypatch.setattr(minhash, "BLOCK", 300)
    rng, rows = random.Random(5), []
    base = [f"w{k}" for k in range(200)]
    for v in range(60):
        words = base[:]
        for at in rng.sample(range(200), rng.choice([2, 4, 6, 8])):
            words[at] = f"n{v}_{at}"
        rows.append((v, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(df.collect())


def test_empty(none):
    assert minhash.components_of(none.select("doc_id", "text")).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (12, 20), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 11: 10, 12: 10, 20: 10, **{101 + i: 100 for i in range(40)}}


def test_few_edges_have_few_partitions(spark):
    """Rounds of a small graph cost no more tasks and files than its edges call for."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        got = minhash.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
        assert got.rdd.getNumPartitions() == 1 and {r["root"] for r in got.collect()} == {0}
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_of_few_and_many_edges(spark, monkeypatch, few):
    monkeypatch.setattr(minhash, "ROWS", few)
    rng, top = random.Random(5), {}
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(40)] + [(7, 7)]

    def find(n):
        while top.setdefault(n, n) != n:
            n = top[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {(r["node"], r["root"]) for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(n, find(n)) for n in top if any(n in e and e[0] != e[1] for e in edges) and n != find(n)} | {(n, r) for n, r in got if n == r and find(n) == n}


def test_rounds_of_few_edges_are_one_task(spark):
    """No shuffle in a round: the result has one partition, whatever the session's number is, and its jobs few tasks."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    sc, group = spark.sparkContext, "rounds"
    sc.setJobGroup(group, group)
    try:
        minhash.components(edges)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds]
    written = [s for s in stages if s and "checkpoint" in s.name]
    assert len(written) > 2 and all(s.numTasks == 1 for s in written) and len(stages) <= 4 * len(written) + 4


def test_blocks_take_little_room():
    rng = random.Random(6)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(1200):
        words = list(base)
        for at in rng.sample(range(300), 6):
            words[at] = f"x{rng.randrange(6)}_{at}"
        texts.append(" ".join(words))
    n = len(texts)
    for own in ([0] * n, [k % 2 for k in range(n)]):
        rows = pa.table({"node": range(n), "root": range(n), "own": own, "i": [0] * n, "text": texts})
        tracemalloc.start()
        try:
            links = minhash.block_links(50, 100, 5)(rows)
            peak = tracemalloc.get_traced_memory()[1] / 2**20
        finally:
            tracemalloc.stop()
        sets = [frozenset(zip(*(w[k:] for k in range(5)))) for w in map(str.split, texts)]  # noqa: B905
        top = list(range(n))

        def find(a, top=top):
            while top[a] != a:
                a = top[a]
            return a

        for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True):
            assert 100 * len(sets[a] & sets[b]) >= 50 * len(sets[a] | sets[b]) and find(a) != find(b) and (own[a] != own[b] or not any(own))
            top[find(a)] = find(b)
        assert peak < 75
