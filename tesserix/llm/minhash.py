"""MinHash near-dedup: universal hash minima, bands, verification, star-alternating components.

1. A scan gives each document its set size, a 128-bit hash of its shingle set, N_HASHES minima of
   universal hashes and the hashes of the bands. Documents of equal sets form a class, however
   large: from here on a class is one node.
2. Nodes that share a band are linked to two representatives of the band's bucket (the smallest
   and the largest node), so a bucket of n nodes gives 2n pairs, not n squared.
3. A pair whose minima agree too rarely for the threshold (by Z standard errors) is left out;
   the others are confirmed on their full shingle sets.
4. Large-star and small-star alternate until nothing changes; each round is two joins on edges.
5. A bucket may hold nodes that its representatives don't link but others do. So the nodes of
   buckets that still hold several components are compared on their full sets, block against
   block, by products of shingle incidence matrices inside a task, which returns no more than the
   links that join components. A large bucket is split into blocks of about BLOCK shingles; those
   of its largest component are not compared with each other.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROWS, cut, gathered, lean, lean_group, small_batches, table, tidy
from .textkit import WORDS, flat, mixed, shingles, slices

#: Minima of a set, and the most that the probability may be that a pair at the threshold shares no band of them.
N_HASHES, MISS = 100, 1e-5
#: Of the minima, 16 bits are kept for estimates, which can only raise them. Standard errors below the threshold at which a pair's estimate rules it out.
Z = 5.0
#: Shingles and nodes in a block, and columns and cells of an incidence matrix at once.
BLOCK, NODES, COLUMNS, CELLS = 300_000, 2048, 8192, 4_000_000
#: Nodes without a document id have numbers from here on.
NO_ID = 1 << 62

_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(1 << 62, 1 << 63, N_HASHES, dtype=np.uint64) | np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64)
_SALT = _rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64) | np.uint64(1)


def bands_for(threshold: float) -> int:
    """The fewest bands into which the minima divide that keep to MISS: 20 (of 5) at 0.85, 25 (of 4) at 0.8. Very low thresholds have a band for each of the minima and may miss more."""
    return next((b for b in range(1, N_HASHES + 1) if N_HASHES % b == 0 and (1 - threshold ** (N_HASHES // b)) ** b <= MISS), N_HASHES)


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minima of every text that has shingles: one row each."""
    full = np.flatnonzero(np.diff(at))
    out = np.empty((len(full), N_HASHES), np.uint32)
    if len(full):
        starts = at[:-1][full]
        buffer = np.empty(len(hashes), np.uint64)
        for k in range(N_HASHES):
            np.multiply(hashes, _MULT[k], out=buffer)
            buffer += _PLUS[k]
            out[:, k] = np.minimum.reduceat((buffer >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_hashes(sig: np.ndarray, n_bands: int) -> np.ndarray:
    shape = (n_bands, N_HASHES // n_bands)
    parts = sig.reshape(len(sig), *shape).astype(np.uint64)
    return mixed((parts * _SALT.reshape(shape)).sum(axis=2) + np.arange(n_bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def describe(words: int, n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                hashes, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                n, k1, k2 = np.zeros(j - i, np.int64), np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                for d in np.flatnonzero(np.diff(at)):
                    own = np.unique(hashes[at[d] : at[d + 1]])
                    n[d], k1[d], k2[d] = len(own), mixed(own).sum(), mixed(own ^ np.uint64(0xA5A5A5A5)).sum()
                sig = signatures(hashes, at)
                full = np.diff(at) > 0
                null = ~full
                place = np.zeros(j - i + 1, np.int32)
                np.cumsum(full, out=place[1:])
                bands = pa.ListArray.from_arrays(pa.array(place * n_bands, pa.int32()), pa.array(band_hashes(sig, n_bands).ravel()))
                blobs = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((place * (N_HASHES * 2)).astype(np.int32).tobytes()), pa.py_buffer(sig.astype(np.uint16).tobytes())])
                keys = [pa.array(k.view(np.int64), mask=null) for k in (k1, k2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n), *keys, blobs, bands], names=["doc_id", "th", "n_shingles", "k1", "k2", "sig", "bands"])

    return run


def ruled_in(threshold: float):
    """Pairs whose minima don't rule them out."""
    least = N_HASHES * threshold - Z * (N_HASHES * threshold * (1 - threshold)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(flat(batch.column(i))[0].tobytes(), np.uint16).reshape(-1, N_HASHES) for i in (2, 3))
            ok = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(ok) for i in (0, 1)], names=["a", "b"])

    return run


def confirmed(numer: int, denom: int, words: int):
    """Pairs with denom * intersection >= numer * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def sets(nodes: pa.Array, texts: pa.Array, i: int) -> np.ndarray:
            node = nodes[i].as_py()
            if node in known:
                known.move_to_end(node)
                return known[node]
            made = np.unique(shingles(*flat(texts.slice(i, 1)), words)[0])
            known[node] = made
            if len(known) > 64:
                known.popitem(last=False)
            return made

        for batch in batches:
            ok = []
            for i in range(batch.num_rows):
                a, b = sets(batch.column(0), batch.column(2), i), sets(batch.column(1), batch.column(3), i)
                if min(len(a), len(b)) * denom < max(len(a), len(b)) * numer:
                    ok.append(False)
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(denom * both >= numer * (len(a) + len(b) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(ok) for i in (0, 1)], names=["a", "b"])

    return run


def block_links(numer: int, denom: int, words: int):
    """Of the nodes of two blocks (or of one), links that join their components: a forest."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        node, root, own = (rows.column(c).to_numpy() for c in ("node", "root", "own"))
        left = own == rows.column("i")[0].as_py()
        parts = []
        texts = rows.column("text").combine_chunks()
        data, offsets = flat(texts)
        for i, j in slices(offsets):
            hashes, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            parts += [np.unique(hashes[at[k] : at[k + 1]]) for k in range(j - i)]
        sizes = np.array([len(x) for x in parts])
        owner = np.repeat(np.arange(len(parts)), sizes)
        _, which, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = count > 1
        column = (np.cumsum(shared) - 1)[which]
        owner, column = owner[shared[which]], column[shared[which]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        x = np.flatnonzero(left)
        y = x if left.all() else np.flatnonzero(~left)
        both = np.zeros((len(x), len(y)), np.float32)
        place = np.where(left, np.cumsum(left), np.cumsum(~left)) - 1
        width = min(COLUMNS, max(512, CELLS // len(parts)))

        def incidence(side: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
            m = np.zeros((len(side), width), np.float32)
            m[place[of], at] = 1
            return m

        for start in range(0, int(shared.sum()), width):
            lo, hi = np.searchsorted(column, [start, start + width])
            of, at = owner[lo:hi], column[lo:hi] - start
            mine = left[of]
            m = incidence(x, of[mine], at[mine])
            both += m @ (m if y is x else incidence(y, of[~mine], at[~mine])).T
        top = {r: r for r in root.tolist()}

        def find(r: int) -> int:
            while top[r] != r:
                top[r] = r = top[top[r]]
            return r

        out = []
        # row by row, and one link to a component: where most pairs are links, their list would take far more room than the matrix
        for a, row in zip(x.tolist(), both, strict=True):
            shared_ = row.astype(np.int64)
            linked = y[(denom * shared_ >= numer * (sizes[a] + sizes[y] - shared_)) & (root[y] != root[a])]
            for b in linked[np.unique(root[linked], return_index=True)[1]].tolist():
                ra, rb = find(int(root[a])), find(int(root[b]))
                if ra != rb:
                    top[max(ra, rb)] = min(ra, rb)
                    out.append((int(node[a]), int(node[b])))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b); root is the component's smallest node.

    Large-star links each node's larger neighbours to its smallest one, small-star its smaller
    ones; both are an aggregation and a join, so a node with many neighbours is never gathered.
    No round has more edges than came in; these are counted first, so they should be cheap to compute
    again. Up to ROWS of them make a round one task, without shuffles, with windows in place of joins.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    rows, before = edges.count(), None
    few = rows <= ROWS
    stars = cut((pairs.coalesce(1) if few else pairs).distinct())
    least = F.min("v").over(W.partitionBy("u"))
    either = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")
    while few:
        large = stars.coalesce(1).select(either).select("x.*").withColumn("m", F.least("u", least)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        both = F.array(F.struct(F.when(F.col("v") != F.col("m"), F.col("v")).alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        stars = cut(large.withColumn("m", least).select(F.explode(both).alias("x")).select("x.*").where("u IS NOT NULL").distinct())
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    while not few:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        stars = cut(gathered(small, rows))
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


class Graph:
    """The nodes of a corpus and the links between them."""

    def __init__(self, docs: DataFrame, numer: int, denom: int, words: int):
        self.docs, self.numer, self.denom, self.words = docs, numer, denom, words
        small_batches(docs.sparkSession)
        schema = "doc_id long, th long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"
        row = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(lean(describe(words, bands_for(numer / denom))), schema)
        node = F.coalesce("doc_id", F.lit(NO_ID) + F.pmod("k1", F.lit(1 << 61)))
        self.rows = cut(row.withColumn("node", node))
        kinds = self.rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min(F.struct("node", "th", "n_shingles", "sig", "bands")).alias("x"))
        self.nodes = cut(kinds.select("k1", "k2", "x.*"))
        keys = self.nodes.select("node", F.explode("bands").alias("band"))
        tidy(docs.sparkSession)
        often = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
        self.keys = cut(keys.join(often, "band"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are links."""
        sig = self.nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
        sib = self.nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
        held = cut(pairs.join(sig, "a").join(sib, "b").select("a", "b", "sa", "sb").mapInArrow(lean(ruled_in(self.numer / self.denom)), "a long, b long"))
        texts = self.texts(held.select(F.col("a").alias("node")).unionByName(held.select(F.col("b").alias("node"))).distinct())
        ta, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        return held.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(lean(confirmed(self.numer, self.denom, self.words)), "a long, b long")

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of the nodes; rows that repeat in all columns give a node one text."""
        chosen = self.nodes.select("node", "th").join(nodes, "node").select("node", "th", F.when(F.col("node") < NO_ID, F.col("node")).alias("doc_id"))
        texts = self.docs.select(F.col("doc_id").alias("d"), "text", F.xxhash64("text").alias("t"))
        return texts.join(chosen, (F.col("t") == F.col("th")) & F.col("d").eqNullSafe(F.col("doc_id"))).groupBy("node").agg(F.first("text").alias("text"))

    def representative_pairs(self) -> DataFrame:
        ends = self.keys.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
        return self.keys.join(ends, "band").select(F.col("node").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def missed(self, found: DataFrame) -> DataFrame:
        """Links between components within a bucket. Up to three nodes have all been compared already."""
        keys = self.keys.join(found, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
        keys = keys.join(self.nodes.select("node", "n_shingles"), "node")
        by_root = keys.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
        top = by_root.groupBy("band").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots"), F.sum("size").alias("all"), F.max(F.struct("size", "root", "n")).alias("top"))
        parts = lambda size, n: F.ceil(F.greatest(size / BLOCK, n / NODES)).cast("long")
        main, rest = parts(F.col("top.size"), F.col("top.n")), parts(F.col("all") - F.col("top.size"), F.col("n") - F.col("top.n"))
        top = top.where("roots > 1 and n > 3").select("band", F.col("top.root").alias("main"), main.alias("m"), rest.alias("o"))
        at = F.xxhash64("node", F.lit(3))
        own = F.when(F.col("root") == F.col("main"), F.pmod(at, "m")).otherwise(F.col("m") + F.pmod(at, "o"))
        laid = keys.join(top, "band").withColumn("own", own)
        # every pair of blocks of which one at least is outside the main component; first and second say where it stands
        last = F.col("m") + F.col("o") - 1
        pairs = F.when(F.col("own") < F.col("m"), F.transform(F.sequence("m", last), lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))).otherwise(
            F.transform(F.sequence(F.lit(0).cast("long"), last), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
        )
        laid = cut(laid.select("band", "node", "root", "own", F.explode(pairs).alias("p")).select("band", "p.i", "p.j", "node", "root", "own"))
        laid = laid.join(self.texts(laid.select("node").distinct()), "node")
        return laid.groupBy("band", "i", "j").applyInArrow(lean_group(block_links(self.numer, self.denom, self.words)), "a long, b long").distinct()

    def solve(self) -> DataFrame:
        """(node, root) of all nodes that have links."""
        links = cut(self.links(self.representative_pairs()))
        tidy(links.sparkSession)
        found = components(links)
        tidy(found.sparkSession)
        more = cut(self.missed(found))
        tidy(found.sparkSession)
        return found if more.isEmpty() else components(links.unionByName(more))


def components_of(docs: DataFrame, numer: int = 85, denom: int = 100, words: int = WORDS) -> DataFrame:
    """From (doc_id long, text string): doc_id, n_shingles, component_id, kept; one row a document.

    Links: denom * intersection >= numer * union of the sets of distinct shingles. Documents
    without words are linked with nothing. A null doc_id takes part, but never names a component
    unless all its documents are without ids: then component_id is null and they are kept. Rows
    with the same doc_id are one document's: kept alike. An empty table gives an empty result.
    """
    graph = Graph(docs, numer, denom, words)
    roots = graph.solve()
    named = graph.nodes.select("k1", "k2", "node").join(roots, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("c"))
    out = graph.rows.select("doc_id", "n_shingles", "k1", "k2", "node").join(named, ["k1", "k2"], "left")
    c = F.coalesce("c", "node")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(c < NO_ID, c)))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near copies."""
    return components_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
