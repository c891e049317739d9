"""Mixing sources to target weights by entropy balancing.

Among all rates r (copies of a document, 0 to max_repeat) that give each source its target of
words, the ones nearest to the corpus as it is (least sum of r ln r - r, the base rate being 1)
are r = min(max_repeat, exp(lambda * size / scale)) with one multiplier a source. Distributed
Newton steps, kept inside a bracket, find the multipliers: the dual's gradient and curvature are
sums over a histogram of sizes, aggregated by source on the executors. The rates are then rounded
into whole copies, size by size, so that a source's words come as near to its target as its
sizes allow.

Every sum runs over the histogram (source, size, documents), never over one source's rows in
one task; copies are dealt among the documents of one size by their place in hash buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, table, word_count

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix's words as a share of all words, and how often a document may be taken.
TOTAL, MAX_REPEAT = 1.5, 2
#: Parts in which documents of one source and size are ranked side by side.
BUCKETS = 256
#: A source is settled when its words are this near to the target, as a share of it.
CLOSE, STEPS = 1e-9, 60
SRC = ["no_src", "src"]


def source_key(source: Column) -> list[Column]:
    return [source.isNull().alias("no_src"), F.coalesce(source.cast("string"), F.lit("")).alias("src")]


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """From (no_src, src, source_size): target, by filling up to the water level at which no target is above max_repeat times its source.

    One row a source comes in; that is all that the windows here order.
    """
    rank = (F.row_number().over(W.orderBy("no_src", "src")) - 1) % len(weights)
    named = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int"))).withColumn("most", F.col("source_size") * float(max_repeat))
    by = W.orderBy(F.col("most") / F.col("weight"), "no_src", "src")
    whole = W.orderBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    level = (F.lit(total) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # the level is that of the first source that it does not fill up
    open_ = named.withColumn("level", level).withColumn("level", F.when(F.col("most") >= F.col("level") * F.col("weight"), F.col("level")))
    level = F.first("level", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return open_.withColumn("level", level).select(*SRC, "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def multipliers(hist: DataFrame, goals: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(no_src, src, lam, scale): lam null where every document is taken max_repeat times.

    The state has one row a source, as in targets(), and stays in one partition; else every step
    would add a partition for each one of its sums.
    """
    cap = float(max_repeat)
    words = F.col("size").cast("double") * F.col("n")
    scale = hist.groupBy(*SRC).agg((F.sum(words * F.col("size")) / F.greatest(F.sum(words), F.lit(1.0))).alias("scale"))
    state = cut(
        goals.join(scale, SRC).select(
            *SRC, "target", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0).alias("scale"), F.lit(0.0).alias("lam"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"),
            (F.col("source_size") * cap - F.col("target") <= CLOSE * F.col("target")).alias("full"), F.lit(False).alias("done"),
        ).repartition(1)
    )
    for _ in range(STEPS):
        live = state.where(~F.col("full") & ~F.col("done"))
        x = F.col("size") / F.col("scale")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        got = hist.where("size > 0").join(live, SRC).groupBy(*SRC).agg(F.sum(words * F.least(raw, F.lit(cap))).alias("got"), F.sum(F.when(raw < cap, words * raw * x).otherwise(0.0)).alias("slope"))
        f = F.col("got") - F.col("target")
        lo, hi = F.when(f < 0, F.col("lam")).otherwise(F.col("lo")), F.when(f > 0, F.col("lam")).otherwise(F.col("hi"))
        new = F.col("lam") - f / F.col("slope")
        # a step past the bracket, or one on the flat of the dual, halves the bracket or, while that is open, doubles the multiplier
        half = F.when((F.col("l2") > -1e9) & (F.col("h2") < 1e9), (F.col("l2") + F.col("h2")) / 2).otherwise(F.when(f < 0, F.greatest(F.col("lam") * 2, F.lit(1.0))).otherwise(F.least(F.col("lam") * 2, F.lit(-1.0))))
        ok = (F.col("slope") > 0) & (new > F.col("l2")) & (new < F.col("h2")) & (F.abs(new - F.col("lam")) <= 4 * F.greatest(F.abs(F.col("lam")), F.lit(1.0)))
        done = F.abs(f) <= CLOSE * F.col("target")
        on = got.join(state, SRC).withColumns({"l2": lo, "h2": hi})
        on = on.select(*SRC, "target", "scale", F.when(done, F.col("lam")).when(ok, new).otherwise(half).alias("lam"), F.col("l2").alias("lo"), F.col("h2").alias("hi"), "full", done.alias("done"))
        state = cut(state.where("full or done").unionByName(on).repartition(1))
        if state.where("not full and not done").isEmpty():
            break
    else:
        raise ArithmeticError(f"{STEPS} Newton steps left sources away from their targets")
    # the last bits of sums depend on the order of their terms: not those of the rates
    return state.select(*SRC, "scale", F.when(~F.col("full"), F.round("lam", 9)).alias("lam"))


def copies_by_size(hist: DataFrame, goals: DataFrame, lams: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(no_src, src, size, n, m): m copies in all of the n documents of this source and size.

    Rates are rounded size by size; then, from the largest size down, copies are added or taken
    away while they fit into what is missing. The list folded here has one entry for each size
    that a source has, which the longest text bounds, not the number of documents.
    """
    cap = float(max_repeat)
    rate = F.when(F.col("lam").isNull(), F.lit(cap)).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))), F.lit(cap)))
    first = hist.join(lams, SRC).withColumn("m", F.when(F.col("size") > 0, F.floor(F.col("n") * rate + 0.5)).otherwise(0).cast("long"))
    off = first.where("size > 0").groupBy(*SRC).agg(F.sum(F.col("m") * F.col("size")).alias("got"), F.sort_array(F.collect_list(F.struct("size", "n", "m")), asc=False).alias("sizes")).join(goals.select(*SRC, "target"), SRC)
    fold = f"""aggregate(sizes, named_struct('r', target - got, 'd', cast(array() as array<struct<size:bigint,d:bigint>>)), (a, x) ->
        transform(array(if(a.r >= 0, least({max_repeat} * x.n - x.m, cast(floor(a.r / x.size) as bigint)), -least(x.m, cast(floor(-a.r / x.size) as bigint)))), d ->
            if(d = 0, a, named_struct('r', a.r - d * x.size, 'd', concat(a.d, array(named_struct('size', x.size, 'd', d))))))[0])"""
    mended = off.select(*SRC, F.explode(F.expr(fold)["d"]).alias("x")).select(*SRC, F.col("x.size").alias("size"), F.col("x.d").alias("d"))
    return first.join(mended, [*SRC, "size"], "left").select(*SRC, "size", "n", (F.col("m") + F.coalesce("d", F.lit(0))).alias("m"))


def mix(df: DataFrame, size: Column, source: Column, keys: list[str], weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """df with size, source_size, target (its source's) and copies (0 to max_repeat).

    A null source is a source of its own, the last. Rows of size 0 get no copies. Which documents
    of one source and size get the spare copies is decided by a hash of their keys, so reruns
    agree; rows with the same keys are exchangeable. An empty df gives an empty result. Columns
    of df named size, source_size, target or copies are replaced.
    """
    names = fresh(df, "no_src", "src", "bucket", "quota")
    df = df.withColumns({names[0]: source.isNull(), names[1]: F.coalesce(source.cast("string"), F.lit("")), "size": size.cast("long")}).drop("source_size", "target", "copies")
    key = [F.col(k) for k in keys]
    df = df.withColumn(names[2], F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int"))
    parts = cut(df.groupBy(F.col(names[0]).alias("no_src"), F.col(names[1]).alias("src"), "size", F.col(names[2]).alias("bucket")).agg(F.count(F.lit(1)).alias("cnt")))
    hist = cut(parts.groupBy(*SRC, "size").agg(F.sum("cnt").alias("n")))
    goals = cut(targets(hist.groupBy(*SRC).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, total, max_repeat))
    plan = copies_by_size(hist, goals, multipliers(hist, goals, max_repeat), max_repeat)
    before = F.coalesce(F.sum("cnt").over(W.partitionBy(*SRC, "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = F.floor(F.col("m") / F.col("n")).cast("long")
    quota = parts.withColumn("before", before).join(plan, [*SRC, "size"]).join(goals, SRC)
    quota = quota.select(*[F.col(a).alias(b) for a, b in zip([*SRC, "bucket"], names, strict=False)], "size", "source_size", "target", each.alias("copies"), (F.col("m") - each * F.col("n") - F.col("before")).alias(names[3]))
    by = [*names[:3], "size"]
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.xxhash64(*key, F.lit("turn")), *key))
    ranked = df.withColumn("__rank", rank).join(quota, by)
    return ranked.withColumn("copies", (F.col("copies") + (F.col("__rank") <= F.col(names[3])).cast("long")).cast("int")).drop(*names, "__rank")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, in words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = mix(docs, F.col("size"), F.col("source"), ["doc_id"])
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
