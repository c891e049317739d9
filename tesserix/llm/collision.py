"""Approximate nearest neighbours by collision counting over single projections.

Every block of vectors has, for each of PROJECTIONS random directions, its vectors in the order
of their projections. A query first looks at windows of a fixed share around its own projection in all
these orders; the vectors that collide with it most often are verified, which gives a radius within
which its k nearest lie. Virtual rehashing then sets the windows to that radius, however wide: a
vector so near collides in a known share of the orders, so vectors whose collisions reach that share
less Z standard deviations are verified by their exact inner product, however many there are, and
of those below it a share of at most Z's tail is lost. Inner products are searched as distances: a
block's vectors are grouped by norm, and each group's are scaled by its largest norm and get one more
coordinate that puts them on the sphere. Queries are scaled to length one, which leaves their
rankings as they are. Groups are searched from the longest vectors on; a group whose largest norm
can't reach a query's k-th best score so far is left out for that query.

Blocks of queries meet blocks of vectors, so that no task holds more than one of each; a block's
best k go on to a merge by query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

PROJECTIONS, SEED = 128, 7
#: The first look: windows of this share of a block, and candidates for each neighbour asked for.
NARROW, WANTED = 0.4, 20
#: Standard deviations below the expected collisions of a vector at the radius that are still verified.
Z = 1.0
#: The share of orders in which a vector at the radius falls into a window as wide: a normal variable within one deviation.
WITHIN = math.erf(math.sqrt(0.5))
#: Places at which a sorted array is cut.
CUTS = 64
#: Rows of a block of vectors, and of one of queries.
VECTORS, QUERIES = 16_384, 2_048
#: The longest vector of a group is at most so many times as long as its shortest.
SPREAD = 2.0


class Block:
    """The sorted projections of one block of vectors (double, on the sphere).

    Each sorted array is cut at CUTS places, and for every cut the vectors before it are kept as a
    bitmap: a window between two cuts is the difference of two of them, and collisions are counted
    by adding up the windows' bits. Windows are widened to the next cuts, never narrowed.
    """

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.n, self.lines = len(vectors), rng.standard_normal((vectors.shape[1], projections))
        values = (vectors @ self.lines).T.copy()
        order = np.argsort(values, axis=1, kind="stable")
        values = np.take_along_axis(values, order, axis=1)
        places = np.unique(np.linspace(0, self.n, CUTS + 1).round().astype(int))
        # a cut's value is that of the last vector before it, so that of equal values none is left out
        self.edges = np.concatenate((np.full((projections, 1), -np.inf), values[:, places[1:] - 1]), axis=1)
        rank = np.empty(order.shape, np.int64)
        np.put_along_axis(rank, order, np.broadcast_to(np.searchsorted(places[1:], np.arange(self.n), "right"), order.shape), axis=1)
        self.before = np.stack([np.packbits(rank < c, axis=1) for c in range(len(places))], axis=1)

    def _count(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        lines = np.arange(len(begin))
        bits = np.unpackbits(self.before[lines, end] ^ self.before[lines, begin], axis=1, count=self.n)
        return np.add.reduce(bits, axis=0, dtype=np.uint8)

    def first(self, at: np.ndarray, wanted: int) -> np.ndarray:
        """The wanted vectors that collide most often in windows of one share of the block. at: the query's projections."""
        if self.n <= wanted:
            return np.arange(self.n)
        last = self.edges.shape[1] - 1
        mid = (self.edges < at[:, None]).sum(axis=1)
        begin = np.clip(mid - max(1, round(NARROW * last / 2)), 0, last)
        count = self._count(begin, np.clip(begin + max(2, round(NARROW * last)), 0, last))
        return np.argpartition(-count.astype(np.int16), wanted - 1)[:wanted]

    def within(self, at: np.ndarray, radius: float) -> np.ndarray:
        """The vectors whose collisions, in windows as wide as the radius, don't rule out that they are within it."""
        m, last = self.edges.shape[0], self.edges.shape[1] - 1
        begin = (self.edges < (at - radius)[:, None]).sum(axis=1) - 1
        end = (self.edges < (at + radius)[:, None]).sum(axis=1)
        count = self._count(np.clip(begin, 0, last), np.clip(end, 0, last))
        return np.flatnonzero(count >= m * WITHIN - Z * math.sqrt(m * WITHIN * (1 - WITHIN)))


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, added up component by component: equal vectors have equal scores wherever they stand."""
    out = np.zeros(len(vectors))
    for column, c in zip(vectors.T, query.tolist(), strict=True):
        out += column * c
    return out


def best_of(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, some: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of some and their exact scores; a fast product first leaves out those that can't be among them."""
    if len(some) > k:
        rough = vectors[some] @ query
        near = np.abs(vectors[some]).max() * np.abs(query).sum() * 1e-12
        some = some[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - near]
    score = exact(vectors[some], query)
    order = np.lexsort((ids[some], -score))[:k]
    return some[order], score[order]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lengths(x: np.ndarray) -> np.ndarray:
    """Norms, of very large and very small components too."""
    most = np.abs(x).max(axis=1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1))


def _by_norm(norms: np.ndarray) -> list[np.ndarray]:
    """Places of the vectors by groups of similar norms, the longest first."""
    order = np.argsort(-norms, kind="stable")
    out = []
    while len(order):
        n = int(np.searchsorted(-norms[order], -norms[order[0]] / SPREAD, "right"))
        out.append(np.sort(order[:n]))
        order = order[n:]
    return out


def _sphere(x: np.ndarray, top: float) -> np.ndarray:
    x = x / top
    return np.column_stack((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))))


def search_block(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            ids, vectors, qids, queries = right.column("id").to_numpy(), _matrix(right.column("v")), left.column("id").to_numpy(), _matrix(left.column("v"))
            norms, lengths = _lengths(vectors), _lengths(queries)
            flat = np.column_stack((queries / lengths[:, None], np.zeros(len(queries))))
            none = np.zeros(0, np.int64)
            bests, least = [(none, np.zeros(0))] * len(queries), np.full(len(queries), -np.inf)
            for group in _by_norm(norms):
                top = norms[group].max()
                asked = np.flatnonzero(least <= lengths * top * (1 + 1e-9))
                if not len(asked):
                    break
                block = Block(_sphere(vectors[group], top))
                for q, at in zip(asked.tolist(), flat[asked] @ block.lines, strict=True):
                    for look in (0, 1):
                        if look == 0:
                            found = group[block.first(at, WANTED * k + 1)]
                        elif least[q] == -np.inf:
                            found = group
                        else:
                            # the k-th best score as a distance on the sphere
                            found = group[block.within(at, math.sqrt(max(0.0, 2 - 2 * least[q] / (lengths[q] * top))) + 1e-9)]
                        found = np.union1d(bests[q][0], found[ids[found] != qids[q]])
                        bests[q] = best_of(ids, vectors, queries[q], found, k)
                        if len(bests[q][0]) == k:
                            least[q] = bests[q][1][-1]
                        if block.n <= WANTED * k + 1:
                            break
            for q, (found, score) in enumerate(bests):
                out += [(int(qids[q]), int(ids[f]), float(x)) for f, x in zip(found, score, strict=True)]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def search(df: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product, nearest first, ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null
    ids or vectors of other lengths than most have. A query's own id is no candidate of its. With
    fewer candidates than k, all are returned. Of rows with the same id the one with the smallest
    vector counts, among the queries too. Columns of other names don't matter. An empty df gives
    an empty result.
    """

    def sound(x: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector), lambda c: c.cast("double"))
        ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
        rows = x.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & ok)
        return rows.groupBy("id").agg(F.min("v").alias("v"))

    rows, asked = cut(sound(df)), cut(sound(queries))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    n, dims = (sizes["n"], sizes["d"]) if sizes else (0, 0)
    rows, asked = rows.where(F.size("v") == dims), asked.where(F.size("v") == dims)
    nv, nq = max(1, -(-n // VECTORS)), max(1, -(-asked.count() // QUERIES))
    blocks = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    right = rows.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int")).withColumn("qb", blocks(nq))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("vb", blocks(nv))
    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(search_block(k), "query_id long, vec_id long, score double")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", 20)
