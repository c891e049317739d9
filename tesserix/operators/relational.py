"""Mapping ids, de-duplication, activity filters, splits and samples of ratings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LIKED, SEED = 3.5, 42


def mapped(ratings: DataFrame, links: DataFrame) -> DataFrame:
    """Ratings under the other identifier; those without one go, several links fan out."""
    to = links.where("tmdbId IS NOT NULL")
    return ratings.join(to, "movieId").drop("movieId").withColumnRenamed("tmdbId", "movieId")


def deduplicated(ratings: DataFrame, keys: tuple[str, ...] = ("userId", "movieId")) -> DataFrame:
    """One row a key, with the largest value of each other column."""
    return ratings.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ratings.columns if c not in keys])


def since(ratings: DataFrame, movies: DataFrame, year: int = 2000) -> DataFrame:
    return ratings.join(movies.where(F.col("release_year") >= year).select(F.col("id").alias("movieId")), "movieId", "left_semi")


def at_least(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose key has n rows or more: counted apart, so that a frequent key's rows stay where they are."""
    often = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= n).select(key)
    return df.join(often, key, "left_semi")


def reliable(ratings: DataFrame, users: int = 5000, per_movie: int = 5, per_user: int = 10) -> DataFrame:
    """Rows of the first users whose movie and user both have enough rows among these."""
    first = ratings.select("userId").distinct().orderBy("userId").limit(users)
    some = ratings.join(first, "userId", "left_semi")
    films = some.groupBy("movieId").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= per_movie).select("movieId")
    people = some.groupBy("userId").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= per_user).select("userId")
    return some.join(films, "movieId", "left_semi").join(people, "userId", "left_semi")


def shuffled(*keys: Column | str, seed: int = SEED) -> Column:
    """A fixed random order, the same in every engine."""
    return F.md5(F.concat_ws(":", *[F.col(k) if isinstance(k, str) else k for k in keys], F.lit(str(seed))).cast("binary"))


def sampled_users(ratings: DataFrame, most: int = 10_000, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """(userId, train): at most most users, of whom the first share in shuffled order train. The limit bounds what the window orders."""
    some = ratings.select("userId").distinct().orderBy(shuffled("userId"), "userId").limit(most)
    place, n = F.row_number().over(W.orderBy(shuffled("userId"), "userId")), F.count(F.lit(1)).over(W.partitionBy())
    return some.select("userId", (place <= F.floor(n * share[0] / share[1])).alias("train"))


def known_and_hidden(ratings: DataFrame) -> DataFrame:
    """ratings with known: of each user's history in order of time the first 80 %, of two to four rows all but the last, of one that one."""
    own = W.partitionBy("userId")
    place, n = F.row_number().over(own.orderBy("rating_year", "movieId")), F.count(F.lit(1)).over(own)
    split = F.expr("CASE WHEN n >= 5 THEN rn <= n * 4 div 5 WHEN n >= 2 THEN rn < n ELSE true END")
    return ratings.withColumns({"rn": place, "n": n}).withColumn("known", split).drop("rn", "n")


def dealt(df: DataFrame, keys: tuple[str, ...], name: str, part: Callable[[Column, Column], Column], seed: int | str = SEED) -> DataFrame:
    """df with name: part of a row's rank (1 to n, in the fixed random order of its keys) and n, for a part that is the same from one rank to another wherever it is the same at both.

    Rows are counted in 65,536 hash buckets, and only these counts are ordered in one place. Most buckets lie in one part whole, so that their rows stay where they are; the rows of the few others are ranked.
    """
    order = shuffled(*keys, seed=seed)
    rows = df.withColumn("__bucket", F.substring(order, 1, 4))
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__here"))
    counts = counts.select("__bucket", "__here", (F.sum("__here").over(W.orderBy("__bucket")) - F.col("__here")).alias("__before"), F.sum("__here").over(W.partitionBy()).alias("__n"))
    before, n = F.col("__before"), F.col("__n")
    counts = counts.select("__bucket", "__before", "__n", part(before + 1, n).alias("__first"), part(before + F.col("__here"), n).alias("__last"))
    one = F.col("__first") == F.col("__last")
    whole = rows.join(F.broadcast(counts.where(one).select("__bucket", F.col("__first").alias(name))), "__bucket").drop("__bucket")
    place = F.row_number().over(W.partitionBy("__bucket").orderBy(order, *keys))
    torn = rows.join(F.broadcast(counts.where(~one)), "__bucket").withColumn("__rank", before + place).withColumn(name, part(F.col("__rank"), n))
    return whole.unionByName(torn.select(whole.columns))


def row_split(df: DataFrame, *keys: str, share: tuple[int, int] = (1, 5)) -> DataFrame:
    """df with test: a random share of the rows, rounded up."""
    return dealt(df, keys, "test", lambda rank, n: rank <= F.ceil(n * share[0] / share[1]))


def folds(df: DataFrame, *keys: str, k: int = 5) -> DataFrame:
    """df with fold (0 to k - 1): contiguous parts of the random order, the first ones larger by a row where they must."""

    def fold(rank: Column, n: Column) -> Column:
        more, size = n % k, F.floor(n / k)
        return F.when(rank <= more * (size + 1), F.floor((rank - 1) / (size + 1))).otherwise(more + F.floor((rank - 1 - more * (size + 1)) / size)).cast("int")

    return dealt(df, keys, "fold", fold)


def stratified_folds(df: DataFrame, label: str, *keys: str, k: int = 5) -> DataFrame:
    """df with fold: every label's rows spread evenly over the folds, by their random order."""
    place = F.row_number().over(W.partitionBy(label, "__part").orderBy(shuffled(*keys), *keys))
    # a frequent label is ranked in 256 parts, each of which is spread evenly
    rows = df.withColumn("__part", F.substring(shuffled(*keys), 1, 2))
    return rows.withColumn("fold", ((place - 1 + F.conv("__part", 16, 10).cast("int")) % k).cast("int")).drop("__part")


def time_split(ratings: DataFrame, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """ratings with train: of each user's history in order of time the first share, rounded down; without years in a fixed random order."""
    own = W.partitionBy("userId")
    order = ["rating_year", "movieId"] if "rating_year" in ratings.columns else [shuffled("userId", "movieId"), "movieId"]
    rows = ratings.withColumns({"__rn": F.row_number().over(own.orderBy(*order)), "__n": F.count(F.lit(1)).over(own)})
    return rows.withColumn("train", F.col("__rn") <= F.floor(F.col("__n") * share[0] / share[1])).drop("__rn", "__n")
