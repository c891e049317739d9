"""Item-to-item collaborative filtering, popularity fallback and its evaluation, for all users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserix.sources.files import kept

from .relational import LIKED

MIN_RATINGS, TOP_K, LEAST, TOP_N, QUANTILE = 5, 20, 0.01, 15, 0.9


def movie_stats(train: DataFrame) -> DataFrame:
    return train.groupBy("movieId").agg(F.count("rating").alias("rating_count"), F.avg("rating").alias("rating_avg"))


def popularity_globals(stats: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row: the mean of the movies' means and the quantile of their counts."""
    return stats.agg(F.avg("rating_avg").alias("c"), F.percentile("rating_count", F.lit(quantile)).alias("m"))


def popularity(stats: DataFrame) -> DataFrame:
    """movieId, score: the rating weighted against the mean by the number of ratings. The single row of globals is broadcast."""
    v, m = F.col("rating_count"), F.col("m")
    both = stats.join(F.broadcast(popularity_globals(stats)), F.lit(True))
    return both.select("movieId", (v / (v + m) * F.col("rating_avg") + m / (v + m) * F.col("c")).alias("score"))


def norms(train: DataFrame) -> DataFrame:
    return train.groupBy("movieId").agg(F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("norm"), F.count("rating").alias("rating_count"))


def co_ratings(train: DataFrame, block: int = 1000) -> DataFrame:
    """(m1, m2, dot) of movies rated by the same user, m1 < m2: half of the pairs, mirrored only after they are summed.

    A long history is dealt into blocks, and pairs of blocks meet in tasks of their own.
    """
    sizes = train.groupBy("userId").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("m"))
    rows = train.join(sizes, "userId").select("userId", "movieId", "rating", "m", F.pmod(F.xxhash64("movieId"), "m").cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    a = rows.select("userId", F.col("movieId").alias("m1"), F.col("rating").alias("r1"), F.col("own").alias("i"), every.alias("j"))
    b = rows.select("userId", F.col("movieId").alias("m2"), F.col("rating").alias("r2"), F.col("own").alias("j"), every.alias("i"))
    return a.join(b, ["userId", "i", "j"]).where("m1 < m2").groupBy("m1", "m2").agg(F.sum(F.col("r1") * F.col("r2")).alias("dot"))


def similarity(train: DataFrame, min_ratings: int = MIN_RATINGS, least: float = LEAST, top: int = TOP_K) -> DataFrame:
    """(movieId, other, score, rank): cosine over the logarithm of the other's ratings."""
    sizes = norms(train).where(F.col("rating_count") >= min_ratings)
    active = train.join(sizes.select("movieId"), "movieId", "left_semi")
    half = co_ratings(active)
    both = half.select(F.explode(F.array(F.struct(F.col("m1").alias("movieId"), F.col("m2").alias("other")), F.struct(F.col("m2").alias("movieId"), F.col("m1").alias("other")))).alias("p"), "dot").select("p.*", "dot")
    mine, its = sizes.select("movieId", F.col("norm").alias("n1")), sizes.select(F.col("movieId").alias("other"), F.col("norm").alias("n2"), "rating_count")
    score = F.col("dot") / (F.col("n1") * F.col("n2")) / F.ln(F.col("rating_count") + 2)
    scored = both.join(mine, "movieId").join(its, "other").select("movieId", "other", score.alias("score")).where(F.col("score") >= least)
    rank = F.row_number().over(W.partitionBy("movieId").orderBy(F.desc(F.round("score", 9)), "other"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def recommend(history: DataFrame, similar: DataFrame, popular: DataFrame, top: int = TOP_N, liked: float = LIKED) -> DataFrame:
    """(userId, movieId, rank, fallback) from the known rows of users: similar movies first, then popular ones that the user neither likes nor has got."""
    users = history.select("userId").distinct()
    seeds = history.where(F.col("rating") >= liked).select("userId", "movieId", "rating")
    near = similar.select("movieId", F.col("other"), F.col("score").alias("sim"))
    found = seeds.join(near, "movieId").groupBy("userId", F.col("other").alias("movieId")).agg(F.sum(F.col("sim") * F.col("rating")).alias("score"))
    found = found.join(seeds.select("userId", "movieId"), ["userId", "movieId"], "left_anti")
    rank = F.row_number().over(W.partitionBy("userId").orderBy(F.desc(F.round("score", 9)), "movieId"))
    # what was found is asked for four times, and similarity below it is the costly part
    found = kept(found.withColumn("rank", rank).where(F.col("rank") <= top).select("userId", "movieId", "rank"))
    # a user needs no more popular movies than are wanted, liked and found together
    taken = seeds.select("userId", "movieId").unionByName(found.select("userId", "movieId"))
    need = users.join(taken.groupBy("userId").agg(F.count(F.lit(1)).alias("taken")), "userId", "left").join(found.groupBy("userId").agg(F.count(F.lit(1)).alias("got")), "userId", "left")
    need = need.where(F.coalesce("got", F.lit(0)) < top).select("userId", F.coalesce("got", F.lit(0)).alias("got"), F.explode(F.sequence(F.lit(1), (F.coalesce("taken", F.lit(0)) + top).cast("int"))).alias("place"))
    # only as many places are ranked as somebody may ask for
    most = need.agg(F.max("place")).first()[0] or 0
    ranked = popular.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "movieId"))).where(F.col("place") <= most)
    fill = need.join(ranked.select("place", "movieId"), "place").join(taken, ["userId", "movieId"], "left_anti")
    turn = F.col("got") + F.row_number().over(W.partitionBy("userId").orderBy("place"))
    fill = fill.select("userId", "movieId", turn.cast("int").alias("rank")).where(F.col("rank") <= top)
    return found.withColumn("fallback", F.lit(False)).unionByName(fill.withColumn("fallback", F.lit(True)))


def user_metrics(recommended: DataFrame, hidden: DataFrame, universe: int | DataFrame, liked: float = LIKED) -> DataFrame:
    """Per user: counts of hits and misses among recommended and hidden movies, accuracy, precision, recall, f1, hit and the same for films that the user liked."""
    both = recommended.select("userId", "movieId", F.lit(1).alias("rec")).join(hidden.select("userId", "movieId", "rating"), ["userId", "movieId"], "full")
    rec, act, joy = F.col("rec").isNotNull(), F.col("rating").isNotNull(), F.coalesce(F.col("rating") >= liked, F.lit(False))
    counted = both.groupBy("userId").agg(F.count_if(rec & act).alias("tp"), F.count_if(rec & ~act).alias("fp"), F.count_if(~rec & act).alias("fn"), F.count_if(rec & joy).alias("e_tp"), F.count_if(~rec & joy).alias("e_fn"))
    counted = counted.where("tp + fp > 0 AND tp + fn > 0").join(F.broadcast(universe), F.lit(True))
    counted = counted.withColumns({"tn": F.expr("movies - tp - fp - fn"), "e_fp": F.expr("tp + fp - e_tp")}).withColumn("e_tn", F.expr("movies - e_tp - e_fp - e_fn"))
    div = lambda a, b: F.expr(f"coalesce(try_divide({a}, {b}), 0.0D)")
    ratios = {
        "accuracy": div("tp + tn", "movies"), "precision": div("tp", "tp + fp"), "recall": div("tp", "tp + fn"), "f1": div("2 * tp", "2 * tp + fp + fn"), "hit_rate": (F.col("tp") > 0).cast("double"),
        "enjoyment_precision": div("e_tp", "tp + fp"), "enjoyment_recall": div("e_tp", "e_tp + e_fn"), "enjoyment_f1": div("2 * e_tp", "2 * e_tp + e_fp + e_fn"),
    }
    return counted.withColumns(ratios).drop("movies")
