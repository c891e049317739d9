"""Feature tables of the supervised models over rating rows with their films."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import content

GENRES, ACTORS, DIRECTORS, KEYWORDS = 15, 20, 10, 25
THIS_YEAR = 2025
MEDIANS, ZEROS = ["release_year", "runtime", "vote_average", "popularity"], ["budget", "revenue", "vote_count"]
#: What a Gaussian feature's name holds, and the prefixes of flags.
GAUSSIAN_WORDS = ["budget", "revenue", "runtime", "vote_average", "vote_count", "popularity", "release_year", "movie_age", "profit", "roi", "cast_size", "user_", "rating_year", "rating_delay", "log", "age"]
FLAGS = ("genre_", "actor_", "director_", "keyword_")


def merged(ratings: DataFrame, movies: DataFrame, credits: DataFrame | None, keywords: DataFrame | None, since: int = content.FIRST_YEAR) -> DataFrame:
    """Rating rows (userId, movieId, rating, rating_year) with their film's columns; films before a year, or without one, go. credits and keywords may be left out."""
    out = ratings.join(movies.withColumnRenamed("id", "movieId"), "movieId", "left").where(F.col("release_year") >= since)
    if credits is not None:
        out = out.join(credits.select(F.col("id").alias("movieId"), "lead_actors", "directors", "cast_size"), "movieId", "left")
    if keywords is not None:
        out = out.join(keywords.select(F.col("id").alias("movieId"), "keywords"), "movieId", "left")
    return out


def plain(name: Column) -> Column:
    """A name as part of a column's name."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_]", "_")


def top_values(rows: DataFrame, values: Column, top: int) -> DataFrame:
    """(value) of the commonest members by rows, ties by name."""
    each = rows.select(F.explode(values).alias("value")).where("value <> ''")
    return each.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top).select("value")


def list_flags(rows: DataFrame, films: DataFrame, values: Column, prefix: str, top: int, named: Column | None = None) -> DataFrame:
    """(id, feature) of films, for the members that are commonest among rating rows. Members whose names become alike share a feature."""
    known = top_values(rows, values, top)
    each = films.select("id", F.explode(values).alias("value")).join(F.broadcast(known), "value")
    return each.select("id", F.concat(F.lit(prefix), plain(F.col("value")) if named is None else named).alias("feature")).distinct()


def genre_flags(rows: DataFrame, films: DataFrame, top: int = GENRES) -> DataFrame:
    return list_flags(rows, films, F.col("genres"), "genre_", top, F.replace(F.lower("value"), F.lit(" "), F.lit("_")))


def actor_flags(rows: DataFrame, films: DataFrame, top: int = ACTORS) -> DataFrame:
    return list_flags(rows, films, F.slice("lead_actors", 1, 5), "actor_", top)


def director_flags(rows: DataFrame, films: DataFrame, top: int = DIRECTORS) -> DataFrame:
    return list_flags(rows, films, F.col("directors"), "director_", top)


def joined_keywords() -> Column:
    return F.array_join(F.slice("keywords", 1, 10), " ")


def keyword_flags(films: DataFrame, top: int = KEYWORDS, stop: list[str] | None = None) -> DataFrame:
    """A binary bag of the commonest words."""
    tf = content.term_counts(films, joined_keywords(), content.stop_words() if stop is None else stop)
    known = tf.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(top)
    return tf.join(F.broadcast(known.select("term")), "term").select("id", F.concat(F.lit("keyword_"), "term").alias("feature"))


def keyword_tfidf(films: DataFrame, top: int = KEYWORDS, stop: list[str] | None = None) -> DataFrame:
    return content.tfidf(films, joined_keywords(), 1.0, "keyword_", top, 1, 1.0, stop)


def numbers(rows: DataFrame) -> DataFrame:
    """rows with the films' filled numbers, logarithms, profit, return and age. Medians are over all rows and broadcast as one row."""
    at = rows.agg(*[F.percentile(c, F.lit(0.5)).alias(f"__{c}") for c in MEDIANS])
    out = rows.join(F.broadcast(at), F.lit(True))
    out = out.withColumns({**{f"{c}_filled": F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")) for c in MEDIANS}, **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ZEROS}})
    out = out.withColumns({**{f"{c}_log": F.log1p(c) for c in ZEROS}, "profit": F.col("revenue") - F.col("budget")})
    return out.withColumns({
        "profit_log": F.log1p(F.greatest("profit", F.lit(0.0))), "roi": F.when(F.col("budget") > 0, F.col("profit") / F.col("budget")).otherwise(0.0), "movie_age": THIS_YEAR - F.col("release_year_filled"),
        "cast_size_filled": F.coalesce("cast_size", F.lit(0)), "adult_clean": F.coalesce("adult", F.lit(False)).cast("int"),
    }).drop(*[f"__{c}" for c in MEDIANS])


def delays(rows: DataFrame) -> DataFrame:
    """rows with rating_delay (years after the filled release year) and rating_delay_clipped (after the raw one, never below 0, its median where unknown)."""
    raw = F.greatest(F.col("rating_year") - F.col("release_year"), F.lit(0)).cast("double")
    out = rows.withColumns({"rating_delay": F.col("rating_year") - F.col("release_year_filled"), "__raw": F.when(F.col("release_year").isNotNull(), raw)})
    at = out.agg(F.percentile("__raw", F.lit(0.5)).alias("__median"))
    return out.join(F.broadcast(at), F.lit(True)).withColumn("rating_delay_clipped", F.coalesce("__raw", "__median")).drop("__raw", "__median")


def moment_parts(moment: Column) -> dict[str, Column]:
    day = F.weekday(moment)
    return {"rating_year": F.year(moment), "rating_month": F.month(moment), "rating_day_of_week": day, "is_weekend": (day >= 5).cast("int")}


def codes(values: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    """(value, code): the distinct values in order, from 0. They are counted in one place, so they should be few."""
    from pyspark.sql import Window as W

    return values.select(F.coalesce(column, F.lit(missing)).alias("value")).distinct().withColumn("code", (F.dense_rank().over(W.orderBy("value")) - 1).cast("int"))


def user_stats(ratings: DataFrame, to: int | None = 3) -> DataFrame:
    """Per user: mean, deviation (0 for one rating), number, first and last year, span of the ratings, rounded. With a column timestamp the span is in years of 365 days between the first and the last."""
    span = (F.max("timestamp") - F.min("timestamp")) / (24 * 3600 * 365) if "timestamp" in ratings.columns else (F.max("rating_year") - F.min("rating_year")).cast("double")
    years = [] if "rating_year" not in ratings.columns else [F.min("rating_year").alias("user_first_year"), F.max("rating_year").alias("user_last_year")]
    out = ratings.groupBy("userId").agg(F.avg("rating").alias("user_rating_mean"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("user_rating_std"), F.count("rating").alias("user_rating_count"), *years, span.alias("user_rating_span"))
    return out if to is None else out.withColumns({c: F.round(c, to) for c in ("user_rating_mean", "user_rating_std", "user_rating_span")})


def routed(types: dict[str, str]) -> dict[str, list[str]]:
    """Columns by family. Flags and codes are categorical; other numbers (long or double) whose names hold a Gaussian word are Gaussian; the rest is left out."""
    out: dict[str, list[str]] = {"gaussian": [], "categorical": []}
    for name, kind in types.items():
        if name.startswith(FLAGS):
            if not (name.startswith("keyword_") and "count" in name) and name != "genre_count":
                out["categorical"].append(name)
        elif kind in ("bigint", "double") and any(w in name for w in GAUSSIAN_WORDS):
            out["gaussian"].append(name)
        elif "binned" in name or "clean" in name:
            out["categorical"].append(name)
    return out
