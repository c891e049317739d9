"""Repeated byte strings against brute force."""

import hashlib
from collections import Counter

import pytest
from conftest import SMALL

from tesserix.llm import suffixes


def brute(rows, length):
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def sharing(rows, passage):
    """Ids of documents that have a string of passage bytes of another id's."""
    owners = {}
    for r in rows:
        t = (r["text"] or "").encode()
        for i in range(len(t) - passage + 1):
            owners.setdefault(t[i : i + passage], set()).add(r["doc_id"])
    return {d for s in owners.values() if len(s) > 1 for d in s}


def result(df, **how):
    return sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffixes.remove_repeats(df, **how).collect()], key=str)


@pytest.mark.parametrize("batches", [1, 4])
def test_edge_rows(edge, batches):
    assert result(edge, batches=batches) == brute(edge.collect(), 400)


def test_short_strings(edge):
    assert result(edge, length=40, gram=16, passage=32) == brute(edge.collect(), 40)


def test_large_groups_meet_by_hash(edge, small, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", 1)
    assert result(edge, length=40, gram=16, passage=32) == brute(edge.collect(), 40)
    assert result(small) == brute(small.collect(), 400)


@pytest.mark.parametrize("group", [8192, 1])
def test_shared_passages(spark, small, group, monkeypatch):
    """Those of named documents, also where a passage is too short to be removed."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    own = lambda k, n: " ".join(f"{k}v{i * i * 7919 % 100003}" for i in range(n))
    said = own("p", 40)[:300]
    rows = [(k, own(f"d{k}", 60) + " " + said + " " + own(f"e{k}", 60)) for k in range(5)] + [(9, own("x", 200)), (10, said[:200]), (11, own("y", 90)[:600] + own("y", 90)[:600])]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (made, small.select("doc_id", "text")):
        got = {r["doc_id"] for r in suffixes.remove_repeats(df).where("shares_passage").collect()}
        assert got == sharing(df.collect(), suffixes.PASSAGE)
    assert got


def test_a_batch_is_scanned_when_it_enters(spark):
    """A repeat of an older level's text is written down by the scan of the batch that brings it."""
    text = " ".join(f"w{i * i * 7919 % 100003}" for i in range(200))
    one = spark.createDataFrame([(1, 1, text)], "d long, t int, text string")
    other = spark.createDataFrame([(2, 2, text[300:])], "d long, t int, text string")
    index = suffixes.Index(spark)
    index.add(one)
    assert spark.read.parquet(index.scans[0]).count() == 0
    index.add(other)
    seen = spark.read.parquet(index.scans[1])
    assert seen.count() > 0 and seen.select("fp").distinct().count() == seen.join(spark.read.parquet(index.levels[-1][1]), "fp", "left_semi").count()


def test_order_of_an_array(spark, small):
    """Entries come by the first bytes of their suffixes."""
    import numpy as np

    for (text,) in small.select("text").limit(20).collect():
        data = np.frombuffer((text or "").encode(), np.uint8)
        _, _, _, fp, _ = suffixes.anchors(data, np.array([0, len(data)]), 400, suffixes.GRAM, suffixes.PASSAGE)
        heads = ((fp.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(40)).tolist()
        order = np.argsort(fp.view(np.int64)).tolist()
        assert [heads[i] for i in order] == sorted(heads)


def test_very_long_text(spark):
    """A text of several slices, of which a part across a slice's end stands in another document."""
    rng = __import__("random").Random(3)
    text = "".join(rng.choice("abcdefghij klmnopé") for _ in range(5_000_000))
    part = text.encode()[3_990_000:4_010_000].decode(errors="ignore")
    df = spark.createDataFrame([(1, text), (2, part)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(df).collect()}
    assert [got[2]["n_removed"], got[1]["n_removed"]] == [len(part.encode())] * 2
    assert got[1]["spans"][0]["start"] - 3_990_000 in (0, 1) and got[1]["shares_passage"] and got[2]["shares_passage"]


def test_long_words(monkeypatch):
    from tesserix.llm import textkit

    import numpy as np

    data = np.frombuffer(b"z" * 50 + b" " + b"ab" * 40, np.uint8)
    spans = np.array([0, 51]), np.array([50, 131])
    whole = textkit.span_hashes(data, *spans)
    monkeypatch.setattr(textkit, "SLICE", 20)
    assert len(set(textkit.span_hashes(data, *spans).tolist())) == 2 and len(set(whole.tolist())) == 2


def test_many_contexts_take_tables_of_a_slice(monkeypatch):
    """However many contexts meet in one place, and their hashes are those of the strings alone."""
    import numpy as np

    asked, powers = [], suffixes.powers
    monkeypatch.setattr(suffixes, "powers", lambda n: asked.append(n) or powers(n))
    rng = np.random.default_rng(5)
    some = rng.integers(0, 256, (500, 600), np.uint8)
    data = np.concatenate((*some, *np.tile(some[:100], (60, 1)), some[7, :300], some[9])).ravel()  # 4 MB
    offsets = np.cumsum([0, *[600] * 6500, 300, 600])
    own, at, h = suffixes.windows(data, offsets, np.full(6502, 3), 400, np.zeros(6502, np.uint64))
    assert own.tolist() == [k for k in range(6502) if k != 6500 for _ in range(3)] and at.tolist() == [0, 1, 2] * 6501
    strings = [data[offsets[k] + i : offsets[k] + i + 400].tobytes() for k, i in zip(own.tolist(), at.tolist(), strict=True)]
    assert len(set(strings)) == 1500 == len(set(h.tolist())) == len(set(zip(strings, h.tolist(), strict=True)))
    assert max(asked) <= suffixes.SLICE + 2


def test_batches_are_bounded(spark):
    from tesserix.llm.common import BATCH

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        suffixes.Index(spark)
        assert spark.conf.get(key) == str(BATCH)
    finally:
        spark.conf.set(key, before)


def test_query(spark, small):
    got = sorted([tuple(r) for r in suffixes.op4_suffix_dedup(spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], key=str)
    assert got == brute(small.collect(), 400)


def test_levels(spark, small):
    """Equal batches: the levels grow as a binary counter."""
    from pyspark.sql import functions as F

    docs = small.select(F.col("doc_id").alias("d"), F.hash("text").alias("t"), "text")
    index = suffixes.Index(spark)
    for k in range(5):
        index.add(docs.where(F.pmod(F.xxhash64("d"), F.lit(5)) == k))
        index.settle()
        assert len({c for c, _ in index.levels}) == len(index.levels)
    assert index.entries().count() > 0


def test_empty(none):
    assert suffixes.remove_repeats(none).collect() == []


def test_clashing_columns(edge):
    from pyspark.sql import functions as F

    assert result(edge.withColumns({"d": F.lit(1), "t": F.lit(2), "spans": F.lit("x"), "kept": F.lit(0)})) == brute(edge.collect(), 400)
