"""Sharding by a hierarchical weighted hash tree.

A topology is a list of regions, a region a list of racks, a rack a list of (shard, weight).
A row descends from the root: at each level every child draws ln(u) / weight, u being a hash of
the row's key and the child's label in (0, 1), and the largest draw wins. A child's draw depends
on nothing but its own label and weight, so when the weights in one subtree change, rows move
only into the subtree (weights up) or out of it (weights down); all others stay. A subtree's
weight is the sum of its leaves'.

A shard that is added stands in a region of its own (grow), so that rows move into it alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, table, utf8

Topology = list[list[list[tuple[int, float]]]]
#: Parts of a shard in which its rows are numbered side by side.
BUCKETS = 1024


def topology(shards: int, racks: int = 2, per_rack: int = 4) -> Topology:
    """Full regions of racks x per_rack shards of weight 1; what is left over stands in regions of one shard each."""
    if shards < 1:
        raise ValueError("there must be a shard")
    full = shards // (racks * per_rack)
    out = [[[((r * racks + k) * per_rack + i, 1.0) for i in range(per_rack)] for k in range(racks)] for r in range(full)]
    return out + [[[(s, 1.0)]] for s in range(full * racks * per_rack, shards)]


def grow(tree: Topology, weight: float = 1.0) -> Topology:
    """One more shard, in a new region: rows go into it and nowhere else."""
    new = 1 + max(s for region in tree for rack in region for s, _ in rack)
    return [*tree, [[(new, weight)]]]


def weight_of(node: object) -> float:
    return node[1] if isinstance(node, tuple) else sum(map(weight_of, node))


def draw(keys: list[Column], label: str, weight: float) -> Column:
    """ln(u) / weight with u in (0, 1) from 53 bits of the hash of key and label."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(label)), 11).cast("double")
    return F.ln((bits + 0.5) / float(2**53)) / F.lit(float(weight))


def descend(keys: list[Column], node: object, label: str = "") -> Column:
    """The shard that a key comes to below node."""
    if isinstance(node, tuple):
        return F.lit(node[0])
    live = [(f"{label}/{i}" if not isinstance(x, tuple) else f"s{x[0]}", x) for i, x in enumerate(node) if weight_of(x) > 0]
    if len(live) == 1:
        return descend(keys, live[0][1], live[0][0])
    won = F.array_max(F.array(*[F.struct(draw(keys, n, weight_of(x)).alias("d"), F.lit(k).alias("k")) for k, (n, x) in enumerate(live)]))["k"]
    if all(isinstance(x, tuple) for _, x in live):
        return F.element_at(F.array(*[F.lit(x[0]) for _, x in live]), won + 1)
    return F.element_at(
        F.transform(F.array(won), lambda w: reduce(lambda c, kx: c.when(w == kx[0], descend(keys, kx[1][1], kx[1][0])), enumerate(live[1:], 1), F.when(w == 0, descend(keys, live[0][1], live[0][0])))), 1
    )


def shard_rows(df: DataFrame, keys: list[str], tree: Topology, grown: Topology | None = None, buckets: int = BUCKETS) -> DataFrame:
    """df with shard, slot (gapless from 0 in each shard) and, given grown, grown_shard.

    Law "key": a row's keys and the topology alone decide. Null keys hash like any other value;
    rows with equal keys share a shard and get slots of their own, in
    the order of a hash of their other columns. Slots: a row's place among the
    rows of its shard and hash bucket, plus the number of rows in the buckets before. The counts
    are shards x buckets rows at most and are broadcast; no task ever holds a whole shard.
    Columns of df named shard, slot or grown_shard are replaced. An empty df gives an empty result.
    """
    df = df.drop("shard", "slot", "grown_shard")
    b, off = fresh(df, "bucket", "before")
    cols = [F.col(k) for k in keys]
    # maps and variants have no hash
    others = [F.col(f"`{f.name.replace('`', '``')}`") for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    placed = df.withColumn("shard", descend(cols, tree).cast("int")).withColumn("grown_shard", (descend(cols, grown) if grown else F.lit(None)).cast("int"))
    placed = placed.withColumn(b, F.pmod(F.xxhash64(*cols, F.lit("slot")), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", b).agg(F.count(F.lit(1)).alias(off))
    before = W.partitionBy("shard").orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("shard", b, F.coalesce(F.sum(off).over(before), F.lit(0)).alias(off))
    rank = F.row_number().over(W.partitionBy("shard", b).orderBy(*cols, F.xxhash64(*others))) - 1
    return placed.withColumn("slot", rank.cast("long")).join(F.broadcast(counts), ["shard", b]).withColumn("slot", F.col("slot") + F.col(off)).drop(b, off)


def op10_sharding(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    """Every document's shard by its doc_id; null texts have no bytes, null and repeated ids are keys like others, an empty table has no rows."""
    docs = table(spark, sf_dir, "documents")
    data = utf8(F.col("text"))
    rows = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("key").alias("law"))
    tree = topology(shards)
    return shard_rows(rows, ["doc_id"], tree, grow(tree)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
