"""Packing documents into token windows, in bounded space.

Each partition keeps a fixed number of open windows. A document's tokens are cut into full
windows; the rest goes into the open window that it fills best. When none has room, the fullest
is emitted and a new one opened. What is open at a partition's end is merged with that of other
partitions, GROUP of them to a task, by cutting pieces to fill windows exactly; the last tokens
of a group go into windows whose lengths are powers of two, which take no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, table, tokenizer_file
from .textkit import first_bytes, flat, slices, span_hashes

LENGTH, END, OPEN, GROUP = 2048, 1, 64, 32
#: Distinct pieces of text whose ids a worker keeps.
CACHE = 1_500_000
TOKENIZER = "byte_bpe_50k"

# Bytes by class: 0 white space, 1 letter, 2 digit, 3 other. Only texts whose letters lie below
# U+0180 are split here; the rest go through the tokenizer itself.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = 1
_CLASS[48:58] = 2
_RARE = np.zeros(256, bool)
_RARE[[*range(9), 11, 12, *range(14, 32), 127, 0xC0, 0xC1, 0xC2, *range(0xC6, 256)]] = True
_TAIL = np.zeros(256, bool)
_TAIL[list(b"stmdrvl")] = True


class Known:
    """Ids by piece hash: two sorted arrays of hashes, the smaller merged into the larger as it grows; emptied at CACHE pieces."""

    def __init__(self):
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0
        self.tiers = [self._tier() for _ in range(2)]

    @staticmethod
    def _tier() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ids or -1, number of ids) of sorted keys."""
        if sum(len(t[0]) for t in self.tiers) > CACHE:
            self.__init__()
        at, size = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for hashes, places, sizes in self.tiers:
            if len(hashes):
                i = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
                hit = hashes[i] == keys
                at[hit], size[hit] = places[i[hit]], sizes[i[hit]]
        return at, size

    def add(self, keys: np.ndarray, made: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, made), np.int64, len(made))
        new = np.fromiter(chain.from_iterable(made), np.uint16, int(size.sum()))
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint16)))
        at = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(new)] = new
        self.used += len(new)
        self._merge(1, (keys, at, size))
        if len(self.tiers[1][0]) > 60_000:
            self._merge(0, self.tiers[1])
            self.tiers[1] = self._tier()
        return at, size

    def _merge(self, k: int, more: tuple) -> None:
        both = [np.concatenate(x) for x in zip(self.tiers[k], more, strict=True)]
        order = np.argsort(both[0], kind="stable")
        self.tiers[k] = tuple(x[order] for x in both)


class Ids:
    """Token ids of whole batches. A piece that the tokenizer's pattern splits off is encoded once and then looked up."""

    def __init__(self, folder: str | None = None, name: str = TOKENIZER):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file(f"{name}.json", folder))
        self.piece = self._pieces(folder, name)
        self.known = Known()

    def _pieces(self, folder: str | None, name: str):
        """The same vocabulary's faster encoder."""
        import base64

        import public_tokenizers
        import tiktoken

        with open(tokenizer_file(f"{name}.tiktoken", folder), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        odd = self._odd(data, offsets)
        out: list = [None] * (len(offsets) - 1)
        for i in np.flatnonzero(odd):
            out[i] = np.array(self.whole.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
        ids, at = self._split(data, offsets)
        for i in np.flatnonzero(~odd):
            out[i] = ids[at[i] : at[i + 1]]
        return out

    @staticmethod
    def _odd(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with characters that the split below does not class, contractions, or special tokens."""
        rare = _RARE[data]
        if len(data) > 1:
            a, b = data[:-1], data[1:]
            rare[:-1] |= (a == 0xC3) & ((b == 0x97) | (b == 0xB7)) | (a == 39) & _TAIL[b] | (a == 60) & (b == 124)
        at = np.flatnonzero(rare)
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, at, "right") - 1] = True
        return out

    def _split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        kind, first = _CLASS[data], first_bytes(offsets, len(data))
        space = kind == 0
        same = np.zeros(len(data), bool)
        same[1:] = kind[1:] == kind[:-1]
        joined = np.zeros(len(data), bool)  # to the blank before it
        joined[1:] = data[:-1] == 32
        joined[1:] &= ~first[1:]
        last = np.zeros(len(data), bool)  # the last blank before something else
        last[:-1] = ~space[1:] & ~first[1:]
        starts = np.flatnonzero(first | np.where(space, ~same | last, ~same & ~joined))
        ends = np.append(starts[1:], len(data))
        keys, where, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at, sizes = self.known.find(keys)
        if len(new := np.flatnonzero(at < 0)):
            # a piece that is no UTF-8 is of an odd text, whose ids are not taken from here
            raw, piece = data.tobytes(), self.piece
            made = [piece(raw[s:e]) for s, e in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
            at[new], sizes[new] = self.known.add(keys[new], made)
        each, begin = sizes[which], at[which]
        to = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(each, out=to[1:])
        begin -= to[:-1]
        place = np.repeat(begin, each)
        place += np.arange(to[-1])
        return self.known.ids[place].astype(np.uint32), to[np.searchsorted(starts, offsets)]


@lru_cache(1)
def ids_of(folder: str | None, name: str) -> Ids:
    return Ids(folder, name)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int64())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long"


class Windows:
    """Best fit into a fixed number of open windows."""

    def __init__(self, most: int, length: int):
        self.most, self.length, self.number = most, length, 0
        self.room: list[tuple[int, int]] = []  # (room left, window), ascending
        self.held: dict[int, list] = {}

    def put(self, piece: tuple, size: int) -> tuple[int, list] | None:
        """Returns the window emitted for it, if any."""
        gone, k = None, bisect_left(self.room, (size, -1))
        if k < len(self.room):
            room, w = self.room.pop(k)
        else:
            if len(self.room) == self.most:
                _, w = self.room.pop(0)
                gone = (w, self.held.pop(w))
            room, w = self.length, self.number
            self.number += 1
            self.held[w] = []
        self.held[w].append((self.length - room, piece))
        if room > size:
            insort(self.room, (room - size, w))
            return gone
        done = (w, self.held.pop(w))
        return done if gone is None else (-1, [gone, done])


def packer(length: int, end: int, most: int, folder: str | None, name: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids_for, windows = ids_of(folder, name), Windows(most, length)
        rows: list[tuple] = []

        def emit(window: int, held: list) -> None:
            if window == -1:
                for x in held:
                    emit(*x)
                return
            for offset, (doc, start, ids, total) in held:
                rows.append((doc, start, len(ids), crc(ids), total, (part << 32 | window) * 2, offset, ids.astype("<u4").tobytes() if keep_ids else None, None))

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), PIECE, strict=True)], names=[n for n, _ in PIECE])
            rows.clear()
            return made

        for batch in batches:
            docs = batch.column(0).to_pylist()
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                for doc, ids in zip(docs[i:j], ids_for(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), strict=True):
                    ids = np.append(ids, np.uint32(end)).astype(np.uint32)
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length]
                        if done := windows.put((doc, start, piece, len(ids)), len(piece)):
                            emit(*done)
                if len(rows) >= 2000:
                    yield out()
        for _, held in sorted(windows.held.items()):
            for _, (doc, start, ids, total) in held:
                rows.append((doc, start, len(ids), crc(ids), total, None, None, ids.astype("<u4").tobytes(), part))
        if rows:
            yield out()

    return run


def merge_open(rows, length: int, keep_ids: bool):
    """Pieces of open windows, in a fixed order, cut to fill windows; the last ones have power-of-two lengths."""
    import pandas as pd

    rows = rows.sort_values(["part", "doc_id", "start", "ids_crc32"], na_position="last")
    total = int(rows["length"].sum())
    ends = [length] * (total // length) + [1 << b for b in range(length.bit_length(), -1, -1) if total % length >> b & 1]
    out, window, at = [], 0, 0
    group = int(rows["group"].iloc[0]) if len(rows) else 0
    for doc, start, blob, tokens in zip(rows["doc_id"].tolist(), rows["start"], rows["ids"], rows["doc_tokens"], strict=True):
        ids = np.frombuffer(blob, "<u4")
        while len(ids):
            take = ids[: ends[window] - at]
            out.append((None if doc is None or doc != doc else int(doc), int(start), len(take), crc(take), int(tokens), (group << 32 | window) * 2 + 1, at, take.tobytes() if keep_ids else None))
            start, ids, at = start + len(take), ids[len(take) :], at + len(take)
            if at == ends[window]:
                window, at = window + 1, 0
    made = pd.DataFrame(out, columns=[n for n, _ in PIECE[:-1]])
    made["doc_id"] = made["doc_id"].astype("Int64")
    return made


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, open_windows: int = OPEN, tokenizer: str = TOKENIZER, folder: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A null or empty text is the end id alone. A null doc_id stays null. Rows that are equal are
    packed each for itself; other columns of df are left out. An empty df gives an empty result.
    length must be a power of two. keep_ids=False leaves ids null, so that only digests move.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = cut(rows.mapInArrow(lean(packer(length, end, open_windows, folder, tokenizer, keep_ids)), SCHEMA))
    done = pieces.where("part is null").drop("part")
    # tasks hold the open windows of GROUP partitions, however many partitions there are
    left = pieces.where("part is not null").withColumn("group", F.floor(F.col("part") / GROUP))
    merged = left.groupBy("group").applyInPandas(lambda x: merge_open(x, length, keep_ids), SCHEMA.removesuffix(", part long"))
    return done.unionByName(merged)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return pack(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
