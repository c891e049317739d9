"""Removal of repeated byte strings by a family of sorted suffix arrays of logarithmically many levels.

The arrays are sparse: they hold the suffixes that start at content-defined anchors, the byte whose
GRAM-byte string has the least hash in a run of PASSAGE - GRAM + 1. Every string of PASSAGE bytes
holds an anchor, and equal strings hold it at the same place, so long strings can only be equal
where anchors agree. An entry is (fp, ctx, place): fp orders suffixes by their first HEAD bytes
and then by the hash of their first GRAM; ctx is the hash of all bytes of the strings that this
anchor stands for.

A level is a table of entries in order of fp. A batch's entries are sorted into an array of their
own, which is merge-scanned against the levels there are: fps that the batch shares with them, or
has twice, are written down as matches, with whether their contexts differ. Before the next batch
comes, levels of one size class are merged, so n batches leave log n levels.

Matches are read out once, against the texts, which no level holds. Entries with equal fp and ctx
repeat each other in whole. Of those that only share fp, one of each ctx takes its bytes along, and
the strings that two of them have are found side by side in one group, or, where a group is too
large for that, by meeting at their hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, forget_later, shared_dir, small_batches, stored, table
from .textkit import SLICE, flat, mixed, powers, slices

#: Bytes of a string that is removed where it repeats, of an anchor's string, and of a passage that is reported.
LENGTH, GRAM, PASSAGE = 400, 72, 272
#: First bytes of a suffix that order it before its hash does.
HEAD = 3
#: Batches in which the query's documents enter the index.
BATCHES = 2
#: A batch of up to this many entries is of the lowest size class; each class is twice the one before.
SMALLEST = 1 << 16
#: Contexts of one anchor string that are compared in one place; more of them meet by hash.
GROUP = 8192


def prefix_sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def hashes_at(total: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    return mixed((total[starts + lengths] - total[starts]) * powers(len(total))[1][starts])


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over each run of width items, by doubling."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, passage: int, until: int | None = None) -> tuple[np.ndarray, ...]:
    """(text, first, last, fp, ctx): the passages that start at first to last of a text have their anchor in common.

    ctx covers these passages and the strings of length bytes that start with them. The passages
    of a run of equal anchors are one entry; of several least hashes the last counts. Passages
    that start at until or later are left out.
    """
    n = np.diff(offsets)
    if not (n >= passage).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    width, size = passage - gram + 1, len(data)
    total = prefix_sums(data)
    gram_hash = (total[gram:] - total[:-gram]) * powers(size + 1)[1][: size - gram + 1]
    gram_hash ^= gram_hash >> np.uint64(31)
    gram_hash *= np.uint64(0x9FB21C651E98DF25)
    # the low bits hold the place and make the later of equal hashes the smaller; equal strings have the same ties, so they agree
    low = np.uint64((1 << size.bit_length()) - 1)
    key = (gram_hash & ~low) | (low - np.arange(len(gram_hash), dtype=np.uint64))
    least = sliding(key, width, np.minimum)  # least[s] belongs to the passage that starts at s
    ok = np.arange(len(least)) + passage <= np.repeat(offsets[1:], n)[: len(least)]
    if until is not None:
        ok[until:] = False
    starts = np.flatnonzero(ok)
    value = least[starts]
    at = (low - (value & low)).astype(np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    new = np.empty(len(starts), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, b, p, t = starts[first], starts[last], at[first], text[first]
    end = np.minimum(b + length, offsets[t + 1])
    ctx = hashes_at(total, a, end - a) ^ mixed((p - a).astype(np.uint64) * np.uint64(1 << 40) + (b - a).astype(np.uint64) * np.uint64(1 << 20) + (end - a).astype(np.uint64))
    head = np.zeros(len(p), np.uint64)
    for k in range(HEAD):
        head = (head << np.uint64(8)) | data[p + k]
    # the sign bit is turned over, so that the order of the numbers is that of the bytes
    fp = ((head << np.uint64(64 - 8 * HEAD)) | (mixed(gram_hash[p]) >> np.uint64(8 * HEAD))) ^ np.uint64(1 << 63)
    return t, a - offsets[t], b - offsets[t], fp, ctx


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int, int | None]]:
    """(first text, last, first byte, last, starts to take) of slices; a text longer than a slice comes in overlapping parts."""
    for i, j in slices(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * SLICE:
            yield i, j, lo, hi, None
        else:
            for c in range(lo, hi, SLICE):
                yield i, j, c, min(hi, c + SLICE + length - 1), SLICE


def entries(length: int, gram: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for i, j, lo, hi, until in pieces(offsets, length):
                t, a, b, fp, ctx = anchors(data[lo:hi], np.clip(offsets[i : j + 1], lo, hi) - lo, length, gram, passage, until)
                own, shift = pa.array(t + i), lo - int(offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array((a + shift).astype(np.int32)), pa.array((b + shift).astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(ctx.view(np.int64))], names=["d", "t", "a", "b", "fp", "ctx"])

    return run


def contexts(length: int):
    """Of rows (d, t, parts, text) the parts (a, b, fp) with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = (batch.column(3)[k].as_py() or "").encode()
                parts = batch.column(2)[k].values
                for start in range(0, len(parts), 2000):
                    some = parts.slice(start, 2000)
                    a, b, fp = (some.field(c) for c in ("a", "b", "fp"))
                    own = pa.array(np.full(len(some), k))
                    bits = pa.array([data[x : y + length] for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([fp, batch.column(0).take(own), batch.column(1).take(own), a, b, bits], names=["fp", "d", "t", "a", "b", "bytes"])

    return run


def windows(data: np.ndarray, offsets: np.ndarray, n: np.ndarray, length: int, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start in it, hash) of the strings of length bytes that are among a context's first n."""
    count = np.clip(np.minimum(np.diff(offsets) - length + 1, n), 0, None)
    own = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    h = np.zeros(len(own), np.uint64)
    done = 0
    for i, j in slices(offsets):  # sums and powers of a slice, however many contexts there are
        x = slice(done, done + int(count[i:j].sum()))
        if x.start < x.stop:
            h[x] = hashes_at(prefix_sums(data[offsets[i] : offsets[j]]), offsets[own[x]] - offsets[i] + at[x], length) ^ salt[own[x]]
        done = x.stop
    return own, at, h


def side_by_side(length: int, passage: int):
    """From contexts sorted by fp: runs (d, t, a, b) of starts of repeated strings, and whether another document has a passage (b < a: only that)."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        fp, d, a, b = (rows.column(c).to_numpy() for c in ("fp", "d", "a", "b"))
        data, offsets = flat(rows.column("bytes"))
        salt = mixed(fp.view(np.uint64))
        out = []
        own, at, h = windows(data, offsets, b - a + 1, length, salt)
        if len(own):
            _, which, count = np.unique(h, return_inverse=True, return_counts=True)
            again = count[which] > 1
            own, at = own[again], at[again]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(own)) - 1
            if len(first):
                out.append((own[first], a[own[first]] + at[first], a[own[first]] + at[last], np.zeros(len(first), bool)))
        own, _, h = windows(data, offsets, b - a + 1, passage, salt)
        if len(own):
            # strings that two documents have: of each string, whether its first and last document differ
            order = np.lexsort((d[own], h))
            own, h = own[order], h[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            last = np.append(first[1:], len(h)) - 1
            shared = np.repeat(d[own[first]] != d[own[last]], last - first + 1)
            who = np.unique(own[shared])
            out.append((who, a[who], a[who] - 1, np.ones(len(who), bool)))
        who, x, y, cross = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool))
        own = pa.array(who)
        return pa.RecordBatch.from_arrays([rows.column("d").take(own).combine_chunks(), rows.column("t").take(own).combine_chunks(), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(cross)], names=["d", "t", "a", "b", "cross"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                held.append(part)
                fp = part.column("fp").to_numpy()
                cut = int(np.searchsorted(fp, fp[-1]))  # the last group may go on
                if cut and sum(x.num_rows for x in held) >= 2000:
                    held[-1] = part.slice(0, cut)
                    yield found(pa.Table.from_batches(held))
                    held = [part.slice(cut)]
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def by_hash(length: int, passage: int):
    """All strings of contexts as rows (h, long, d, t, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                fp, a, b = (rows.column(c).to_numpy() for c in ("fp", "a", "b"))
                data, offsets = flat(rows.column("bytes"))
                for size in (length, passage):
                    own, at, h = windows(data, offsets, b - a + 1, size, mixed(fp.view(np.uint64) + np.uint64(size)))
                    who = pa.array(own)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(own), size == length)), rows.column("d").take(who), rows.column("t").take(who), pa.array((a[own] + at).astype(np.int32))], names=["h", "long", "d", "t", "s"])
                    if length == passage:
                        break

    return run


def cleaned(length: int):
    """Texts less what their runs of repeated strings cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                runs: list[list[int]] = []
                for a, b in sorted((s["a"], min(s["b"], len(data) - length)) for s in spans.as_py() or ()):
                    if b < a:
                        continue
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b + length)
                    else:
                        runs.append([a, b + length])
                edges = [0, *[x for r in runs for x in r], len(data)]
                kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                rows.append((len(data), len(data) - len(kept), len(runs), kept, [{"start": a, "end": b} for a, b in runs]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), *columns], names=["doc_id", "shares_passage", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return run


class Index:
    """Levels of sorted entries in the shared folder, and the matches that the scans of their batches wrote down."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE):
        if not HEAD <= gram < passage <= length:
            raise ValueError("an anchor's string must be shorter than a passage, and that no longer than what is removed")
        small_batches(spark)
        self.spark, self.length, self.gram, self.passage, self.folder = spark, length, gram, passage, f"{shared_dir(spark)}/suffixes-{uuid.uuid4().hex}"
        self.levels: list[tuple[int, str]] = []  # (size class, path), large ones first
        self.scans: list[str] = []
        self.made = 0

    def _write(self, df: DataFrame) -> tuple[int, str]:
        path = f"{self.folder}/{self.made}"
        self.made += 1
        return max(0, (stored(df, path).count() // SMALLEST).bit_length()), path

    def settle(self) -> None:
        """Merges levels until no two have the same size class."""
        while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
            (_, x), (_, y) = self.levels.pop(), self.levels.pop()
            # an entry's own place deals it out too, so that a string that many documents hold is no single task's
            both = self.spark.read.parquet(x, y).repartitionByRange("fp", "ctx", "d", "a")
            self.levels.append(self._write(both.sortWithinPartitions("fp", "ctx")))
            discard(self.spark, x)
            discard(self.spark, y)

    def add(self, docs: DataFrame) -> None:
        """docs: (d, t, text), d and t naming a document."""
        self.settle()
        made = docs.select("d", "t", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(entries(self.length, self.gram, self.passage), "d long, t int, a int, b int, fp long, ctx long")
        level = self._write(made.sortWithinPartitions("fp", "ctx"))
        new = self.spark.read.parquet(level[1]).select("fp", "ctx", F.lit(True).alias("new"))
        if self.levels:
            new = new.unionByName(self.entries().select("fp", "ctx", F.lit(False).alias("new")))
        shared = new.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi"), F.max("new").alias("new")).where("new and n > 1")
        path = f"{self.folder}/scan-{len(self.scans)}"
        stored(shared.select("fp", (F.col("lo") != F.col("hi")).alias("part")), path)
        self.scans.append(path)
        self.levels.append(level)
        forget_later(self.spark, self.folder)

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(*[p for _, p in self.levels])

    def repeats(self, docs: DataFrame) -> DataFrame:
        """(d, t, a, b, cross): runs of repeated strings, by their first and last start, and whether another document has the passages there (b < a: only that). docs must hold all documents of the index."""
        # written, as sizes below, so that Spark can split the rows of a common fp in the join
        marks = stored(self.spark.read.parquet(*self.scans).groupBy("fp").agg(F.max("part").alias("part")))
        found = stored(self.entries().join(marks, "fp"))
        place = F.struct("d", "t", "a", "b")
        kinds = found.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.first("part").alias("part"), F.min(place).alias("one"))
        kinds = stored(kinds)
        whole = kinds.where("n > 1").select("fp", "ctx", (F.col("lo") != F.col("hi")).alias("cross"))
        out = found.join(whole, ["fp", "ctx"]).select("d", "t", "a", "b", "cross")
        # anchors with several contexts, of which one at least is single, need a closer look
        sizes = kinds.where("part").groupBy("fp").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("fp", "kinds")
        sizes = stored(sizes)
        near = kinds.where("part").join(sizes, "fp")

        def with_bytes(some: DataFrame) -> DataFrame:
            parts = some.select("one.d", "one.t", F.struct("one.a", "one.b", "fp").alias("p")).groupBy("d", "t").agg(F.collect_list("p").alias("parts"))
            # the same columns of docs as in the removal, so that one exchange of the texts does for both
            both = parts.join(docs, ["d", "t"]).select("d", "t", "parts", "doc_id", "text")
            return both.select("d", "t", "parts", "text").mapInArrow(contexts(self.length), "fp long, d long, t int, a int, b int, bytes binary")

        few = with_bytes(near.where(F.col("kinds") <= GROUP)).repartition("fp").sortWithinPartitions("fp")
        out = out.unionByName(few.mapInArrow(side_by_side(self.length, self.passage), "d long, t int, a int, b int, cross boolean"))
        many = near.where(F.col("kinds") > GROUP)
        if not many.isEmpty():
            each = with_bytes(many).mapInArrow(by_hash(self.length, self.passage), "h long, long boolean, d long, t int, s int")
            again = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).where("n > 1")
            hit = each.join(again, "h").where(F.col("long") | (F.col("lo") != F.col("hi")))
            last = F.when(F.col("long"), F.col("s")).otherwise(F.col("s") - 1)
            out = out.unionByName(hit.select("d", "t", F.col("s").alias("a"), last.alias("b"), (F.col("lo") != F.col("hi")).alias("cross")))
        return out


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE, batches: int = 1) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept (bytes), spans (start, end), shares_passage.

    Every byte covered by a string of length bytes that also starts elsewhere, in this document or
    another, is removed; strings are judged on the input. A null text is empty. Documents are told
    apart by id and text: rows equal in both repeat each other. Removal can cut a character; kept
    is bytes for that. shares_passage: another document (of another id) has a string of passage
    bytes of this one too; nothing is removed for that. Other columns are left out. An empty df
    gives an empty result. batches: how many parts of df enter the index one after the other.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = rows.select(F.coalesce("doc_id", F.xxhash64("text", F.lit(1))).alias("d"), F.hash("text").alias("t"), "doc_id", "text")
    index = Index(df.sparkSession, length, gram, passage)
    for k in range(batches):
        index.add(docs if batches == 1 else docs.where(F.pmod(F.xxhash64("d", "t"), F.lit(batches)) == k))
    # many starts of a document at once: runs of them, by sorting within the document
    spans = index.repeats(docs).groupBy("d", "t").agg(F.collect_set(F.when(F.col("b") >= F.col("a"), F.struct("a", "b"))).alias("spans"), F.max("cross").alias("cross"))
    out = docs.join(spans, ["d", "t"], "left").select("doc_id", "text", "spans", F.coalesce("cross", F.lit(False)).alias("cross"))
    return out.mapInArrow(cleaned(length), "doc_id long, shares_passage boolean, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,end:int>>")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' figures, and as a further column whether another document has a passage of PASSAGE bytes of this one."""
    out = remove_repeats(table(spark, sf_dir, "documents"), batches=BATCHES)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")
