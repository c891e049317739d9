"""Packing against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserix.llm import packing


def ids_of(text):
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*tokens.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, docs, with_ids=True, length=2048):
    """Every id lies in one piece, and sequences have no gaps and are full, or end at a power of two."""
    wanted = defaultdict(list)
    for d in docs:
        wanted[d["doc_id"]].append(ids_of(d["text"]))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(wanted)
    for doc, own in pieces.items():
        whole = wanted[doc]
        assert sum(r["length"] for r in own) == sum(map(len, whole))
        if len(whole) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r["start"]):
                ids = np.array(whole[0][at : at + r["length"]], "<u4")
                assert r["start"] == at and r["doc_tokens"] == len(whole[0]) and r["ids_crc32"] == zlib.crc32(ids.tobytes())
                assert not with_ids or r["ids"] == ids.tobytes()
                at += r["length"]
    tokens = padded = 0
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
        tokens += at
        padded += 0 if at & (at - 1) == 0 else length - at
    return padded / max(1, tokens)


def test_edge_rows(edge):
    check(packing.pack(edge).collect(), edge.collect())


def test_query(spark, small):
    assert check(packing.op7_packing(spark, SMALL).collect(), small.collect(), False) < 0.01


def test_small_windows(edge):
    check(packing.pack(edge.repartition(3), length=64, open_windows=2).collect(), edge.collect(), length=64)


def test_many_partitions(small):
    """More partitions than a group: leftovers meet in several tasks."""
    assert check(packing.pack(small.repartition(70)).collect(), small.collect()) < 0.1


def test_empty(none):
    assert packing.pack(none).collect() == []


def test_other_columns(edge):
    odd = edge.withColumns({"ids": F.lit(1), "part": F.lit(2), "start": F.lit(3), "sequence_id": F.lit("x")})
    check(packing.pack(odd).collect(), edge.collect())


def test_ids_of_odd_texts():
    """The pieces split off here and the tokenizer's own agree."""
    import pyarrow as pa

    from tesserix.llm.textkit import flat

    texts = ["", " ", "  a", "a  b", "it's", "it 's", "x's y'll", "\tq\n\n z ", "été où", "日本", "12ab34", "a_b--c", "\r\nx", "a\x0bb", "tail   ", "d'été", "«x»", "ﬁ", "\x85a", "\xa0a", "²³", "ß×÷", "<|endoftext|>"]
    got = packing.Ids()(*flat(pa.array(texts)))
    assert [g.tolist() for g in got] == [ids_of(t)[:-1] for t in texts]
