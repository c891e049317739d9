"""The rating engine's roles as views over the star schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("userId"), F.year("o_orderdate").alias("rating_year"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("movieId"), (F.ceil(F.col("l_quantity") / 5).cast("double") / 2).alias("rating"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("userId", "movieId", "rating", "rating_year")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    tmdb = F.when(key % 50 == 7, None).when(key % 40 == 1, key - 1).otherwise(key)
    return table(spark, sf_dir, "part").select(key.alias("movieId"), tmdb.alias("tmdbId"))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.col("p_size") + 1970).cast("int").alias("release_year"), F.array_union(F.array("p_type"), F.split("p_name", " ")).alias("genres"), F.col("p_type").alias("primary_genre"),
        F.col("p_brand").alias("original_language"), F.col("p_retailprice").alias("budget"), F.col("p_size").cast("double").alias("runtime"), (F.col("p_type") == "PROMO").alias("adult"),
    )


def film_parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Cleaned movies, credits and keywords; credits and keywords lack some ids, and movies some values."""
    part, e = table(spark, sf_dir, "part"), F.expr
    films = part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), e("concat(p_type, ' The ', p_name)").alias("overview"), e("array_union(array(p_type), split(p_name, ' '))").alias("genres"), F.col("p_type").alias("primary_genre"),
        e("CASE WHEN p_partkey % 37 <> 1 THEN p_brand END").alias("original_language"), e("array(concat('co ', p_brand), concat('co ', p_type))").alias("production_companies"), e("CASE WHEN p_partkey % 5 <> 0 THEN concat('co ', p_brand) END").alias("main_studio"),
        e("CASE WHEN p_partkey % 41 <> 3 THEN p_size + 1970 END").alias("release_year"), e("CASE WHEN p_partkey % 43 <> 3 THEN cast(p_size AS double) END").alias("runtime"), (F.col("p_type") == "PROMO").alias("adult"),
        e("CASE WHEN p_partkey % 23 <> 0 THEN cast(p_partkey % 10 AS double) END").alias("vote_average"), e("CASE WHEN p_partkey % 29 <> 0 THEN p_retailprice / 100 END").alias("popularity"),
        e("CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END").alias("budget"), e("CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice * (p_partkey % 4) END").alias("revenue"), e("cast(p_partkey % 1000 AS double)").alias("vote_count"),
    )
    credits = part.where("p_partkey % 19 <> 3").select(F.col("p_partkey").alias("id"), e("array_append(split(p_name, ' '), p_type)").alias("lead_actors"), e("array(concat(p_brand, ' Jr.'))").alias("directors"), F.lit(3).alias("cast_size"))
    keywords = part.where("p_partkey % 31 <> 2").select(F.col("p_partkey").alias("id"), e("split(lower(concat(p_name, ' ', p_type, ' country')), ' ')").alias("keywords"))
    return {"movies": films, "credits": credits, "keywords": keywords}


#: The films with their credits and keywords for the SQL side.
FILMS = """films AS (
  SELECT p_partkey AS id, p_name AS title, p_type || ' The ' || p_name AS overview, list_concat([p_type], string_split(p_name, ' ')) AS genres, p_type AS primary_genre,
    CASE WHEN p_partkey % 37 <> 1 THEN p_brand END AS original_language, ['co ' || p_brand, 'co ' || p_type] AS production_companies, CASE WHEN p_partkey % 5 <> 0 THEN 'co ' || p_brand END AS main_studio,
    CASE WHEN p_partkey % 41 <> 3 THEN p_size + 1970 END AS release_year, CASE WHEN p_partkey % 43 <> 3 THEN CAST(p_size AS DOUBLE) END AS runtime, p_type = 'PROMO' AS adult,
    CASE WHEN p_partkey % 23 <> 0 THEN CAST(p_partkey % 10 AS DOUBLE) END AS vote_average, CASE WHEN p_partkey % 29 <> 0 THEN p_retailprice / 100 END AS popularity,
    CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS budget, CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice * (p_partkey % 4) END AS revenue, CAST(p_partkey % 1000 AS DOUBLE) AS vote_count,
    CASE WHEN p_partkey % 19 <> 3 THEN list_append(string_split(p_name, ' '), p_type) ELSE [] END AS lead_actors, CASE WHEN p_partkey % 19 <> 3 THEN [p_brand || ' Jr.'] ELSE [] END AS directors,
    CASE WHEN p_partkey % 19 <> 3 THEN 3 END AS cast_size, CASE WHEN p_partkey % 31 <> 2 THEN string_split(lower(p_name || ' ' || p_type || ' country'), ' ') ELSE [] END AS keywords
  FROM part)"""

#: The same views for the SQL side.
VIEWS = """ratings_raw AS (
  SELECT o_custkey AS userId, l_partkey AS movieId, ceil(l_quantity / 5) / 2 AS rating, CAST(year(o_orderdate) AS INTEGER) AS rating_year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
links AS (
  SELECT p_partkey AS movieId, CASE WHEN p_partkey % 50 = 7 THEN NULL WHEN p_partkey % 40 = 1 THEN p_partkey - 1 ELSE p_partkey END AS tmdbId FROM part),
ratings AS (
  SELECT userId, tmdbId AS movieId, max(rating) AS rating, max(rating_year) AS rating_year
  FROM ratings_raw JOIN links USING (movieId) WHERE tmdbId IS NOT NULL GROUP BY 1, 2)"""
