"""The cleaning of the four raw tables: lazy columns over text tables, one pass a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.functions import cleaning as C
from tesserix.sources import files

NUMBERS = ["budget", "revenue", "runtime", "vote_average", "vote_count", "popularity"]
#: Ratings from which a movie's are called reliable.
RELIABLE = 5
#: The columns of the cleaned tables, in order.
CREDITS = ["id", "actors", "lead_actors", "cast_size", "directors", "producers", "writers", "composers"]
KEYWORDS = ["id", "keywords", "keyword_count"]
MOVIES = [
    "id", "title", "original_title", "overview", "genres", "genre_count", "primary_genre", "production_companies", "main_studio", "collection_name", "is_part_of_collection", "release_date", "release_year",
    "release_decade", "budget", "revenue", "runtime", "original_language", "is_english", "adult", "vote_average", "vote_count", "popularity",
]
RATINGS = ["userId", "movieId", "rating", "rating_year", "movie_rating_count", "reliable_movie"]


def text_of(df: DataFrame, name: str) -> Column:
    """A column as text; null throughout where the table has none."""
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def with_id(df: DataFrame, name: str = "id") -> DataFrame:
    """The id as a number, and valid_<id>: whether it is above 0. Rows stay."""
    value = C.number(text_of(df, name)).cast("long")
    return df.withColumns({name: value, f"valid_{name}": C.valid_id(value)})


def credits(raw: DataFrame) -> DataFrame:
    df = with_id(raw).withColumns({"__cast": C.members(text_of(raw, "cast")), "__crew": C.members(text_of(raw, "crew"))})
    cast, crew = F.col("__cast"), F.col("__crew")
    df = df.withColumns({"actors": C.names(cast), "lead_actors": C.lead_names(cast), "directors": C.names_where(crew, C.DIRECTOR), "producers": C.names_where(crew, C.PRODUCER), "writers": C.names_where(crew, C.WRITER), "composers": C.names_where(crew, C.COMPOSER)})
    return df.withColumn("cast_size", F.size("actors")).select(CREDITS)


def keywords(raw: DataFrame) -> DataFrame:
    df = with_id(raw).withColumn("keywords", F.transform(C.names(C.members(text_of(raw, "keywords"))), lambda x: F.lower(x)))
    return df.withColumn("keyword_count", F.size("keywords")).select(KEYWORDS)


def movies_with_flags(raw: DataFrame, current_year: int | None = None) -> DataFrame:
    """All cleaned columns with the flags <number>_valid, release_date_valid and valid_id; columns that raw lacks get their defaults."""
    numbers = {c: C.number(text_of(raw, c)) for c in NUMBERS}
    language = C.language(text_of(raw, "original_language"))
    df = with_id(raw).withColumns({"__genres": C.members(text_of(raw, "genres")), "__makers": C.members(text_of(raw, "production_companies"))})
    df = df.withColumns({
        "genres": C.all_names(F.col("__genres")), "production_companies": C.all_names(F.col("__makers")), "collection_name": C.object_name(text_of(raw, "belongs_to_collection")), **C.date_parts(text_of(raw, "release_date"), current_year),
        **numbers, **{f"{c}_valid": C.valid_number(x) for c, x in numbers.items()}, "adult": C.flag(text_of(raw, "adult")), "original_language": language, "is_english": F.coalesce(language == "en", F.lit(False)),
        **{c: text_of(raw, c) for c in ("title", "original_title", "overview") if c not in raw.columns},
    })
    return df.withColumns({"genre_count": F.size("genres"), "primary_genre": C.first(F.col("genres")), "main_studio": C.first(F.col("production_companies")), "is_part_of_collection": F.col("collection_name") != ""})


def movies(raw: DataFrame, current_year: int | None = None) -> DataFrame:
    return movies_with_flags(raw, current_year).select(MOVIES)


def ratings_with_flags(raw: DataFrame, current_year: int | None = None) -> DataFrame:
    """All rows, with the count of each movie's ratings over all of them. Counts are joined, so that a popular movie's rows stay where they are."""
    user, movie, rating = (C.number(text_of(raw, c)) for c in ("userId", "movieId", "rating"))
    df = raw.select(user.cast("long").alias("userId"), movie.cast("long").alias("movieId"), rating.alias("rating"), *[x.alias(n) for n, x in C.time_parts(C.number(text_of(raw, "timestamp")), current_year).items()])
    df = df.withColumns({"rating_valid": C.valid_rating(F.col("rating")), "userId_valid": C.valid_id(F.col("userId")), "movieId_valid": C.valid_id(F.col("movieId"))})
    counts = df.where("movieId IS NOT NULL").groupBy("movieId").agg(F.count("rating").alias("movie_rating_count"))
    return df.join(counts, "movieId", "left").withColumn("reliable_movie", F.coalesce(F.col("movie_rating_count") >= RELIABLE, F.lit(False)))


def ratings(raw: DataFrame, current_year: int | None = None) -> DataFrame:
    """The only cleaner that drops rows: those with an invalid rating, user, movie or time."""
    return ratings_with_flags(raw, current_year).where("rating_valid AND userId_valid AND movieId_valid AND valid_timestamp").select(RATINGS)


def invalid_ids(raw: DataFrame, name: str = "id") -> DataFrame:
    """One row: how many rows have a missing or no positive id."""
    return with_id(raw, name).agg(F.count_if(~F.col(f"valid_{name}")).alias("invalid"))


def summary(cleaned: dict[str, DataFrame]) -> DataFrame:
    """One row of figures of the cleaned tables; each is an aggregate of one row."""
    parts = [
        cleaned["credits"].agg(F.count(F.lit(1)).alias("credits"), F.avg("cast_size").alias("mean_cast_size"), F.count_if(F.size("directors") > 0).alias("with_director")),
        cleaned["keywords"].agg(F.count(F.lit(1)).alias("keyword_rows"), F.avg("keyword_count").alias("mean_keywords")),
        cleaned["movies_metadata"].agg(F.count(F.lit(1)).alias("movies"), F.count("release_date").alias("valid_dates"), F.count_if(F.col("budget") > 0).alias("with_budget"), F.count_if(F.col("revenue") > 0).alias("with_revenue")),
        cleaned["ratings"].agg(F.count(F.lit(1)).alias("ratings"), F.countDistinct("userId").alias("users"), F.countDistinct("movieId").alias("rated_movies"), F.count_if("reliable_movie").alias("reliable_ratings")),
        cleaned["credits"].select(F.explode("actors").alias("a")).agg(F.countDistinct("a").alias("unique_actors")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part), F.lit(True))
    return out


def clean(raw: dict[str, DataFrame], current_year: int | None = None) -> dict[str, DataFrame]:
    return {"credits": credits(raw["credits"]), "keywords": keywords(raw["keywords"]), "movies_metadata": movies(raw["movies_metadata"], current_year), "ratings": ratings(raw["ratings"], current_year)}


def clean_all(spark: SparkSession, folder: str, current_year: int | None = None) -> dict[str, DataFrame]:
    """The four raw files of a folder, cleaned."""
    return clean(files.load_raw(spark, folder), current_year)
