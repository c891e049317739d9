"""The raw text tables of the cleaning as views over the star schema: ids, JSON, Python literals, dates and numbers, some of them junk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .roles import table

KEY = "p_partkey"


def films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of parts, dealt out over all cores: a small file of many rows is read by few tasks, and its texts take long to make, write and parse."""
    return table(spark, sf_dir, "part").repartition(2 * spark.sparkContext.defaultParallelism)


def movies_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    return films(spark, sf_dir).select(
        e(f"CASE WHEN {KEY} % 97 = 5 THEN 'junk' ELSE cast({KEY} AS string) END").alias("id"), F.col("p_name").alias("title"), F.col("p_name").alias("original_title"), e("concat(p_type, '\\n\"', p_name, '\", again')").alias("overview"),
        e(f"""CASE WHEN {KEY} % 3 = 0 THEN concat('[{{\\'id\\': 1, \\'name\\': \\'', p_type, '\\', \\'x\\': None}}, {{\\'name\\': \\'', p_brand, '\\'}}]')
          WHEN {KEY} % 11 = 4 THEN 'garbage' WHEN {KEY} % 13 = 4 THEN '{{"name":"lone"}}' ELSE concat('[{{"id":1,"name":"', p_type, '"}},{{"name":"', p_brand, '"}},{{"name":""}}]') END""").alias("genres"),
        e(f"CASE WHEN {KEY} % 5 = 0 THEN NULL ELSE concat('[{{\"name\":\"', p_brand, '\"}}]') END").alias("production_companies"),
        e(f"CASE WHEN p_size % 4 = 0 THEN concat('{{\\'id\\': 7, \\'name\\': \\'', p_type, '\\'}}') WHEN p_size % 4 = 1 THEN '[]' END").alias("belongs_to_collection"),
        e(f"CASE WHEN {KEY} % 53 = 0 THEN 'soon' ELSE concat(1970 + p_size, '-0', 1 + {KEY} % 9, '-15') END").alias("release_date"),
        e(f"CASE WHEN {KEY} % 17 = 0 THEN 'n/a' ELSE cast(p_retailprice AS string) END").alias("budget"), e(f"cast(-({KEY} % 3) AS string)").alias("revenue"), F.col("p_size").cast("string").alias("runtime"),
        e("CASE p_type WHEN 'PROMO' THEN 'True' WHEN 'ECONOMY' THEN 'False' ELSE 'maybe' END").alias("adult"), e("CASE WHEN p_size % 3 = 0 THEN ' EN ' WHEN p_size % 3 = 1 THEN lower(p_brand) END").alias("original_language"),
        e(f"cast({KEY} % 10 AS string)").alias("vote_average"), e(f"cast({KEY} % 1000 AS string)").alias("vote_count"),
    )


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cast = """concat('[{"name":"', p_brand, '","order":2},{"name":"', split(p_name, ' ')[0], '"},{"name":"","order":1},{"name":"', split(p_name, ' ')[1], '","order":2},{"name":"', p_type, '","order":0}]')"""
    crew = """concat('[{\\'job\\': \\'Director\\', \\'name\\': \\'', p_brand, '\\'}, {\\'job\\': \\'Executive Producer\\', \\'name\\': \\'', p_type, '\\'}, {\\'job\\': \\'Screenplay\\', \\'department\\': \\'Writing\\', \\'name\\': \\'', p_name,
      '\\'}, {\\'job\\': \\'Original Music Composer\\', \\'name\\': \\'', p_size, '\\'}, {\\'job\\': \\'Director\\'}, {\\'name\\': None}]')"""
    part = films(spark, sf_dir)
    return part.select(F.col(KEY).cast("string").alias("id"), F.expr(f"CASE WHEN {KEY} % 19 = 3 THEN '' ELSE {cast} END").alias("cast"), F.expr(crew).alias("crew"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return films(spark, sf_dir).select(F.col(KEY).cast("string").alias("id"), F.expr("concat('[{\"name\":\"', upper(p_name), '\"},{\"name\":\"\"},{\"name\":\"', p_type, '\"}]')").alias("keywords"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    stars = "CASE WHEN l_linenumber = 6 THEN '7.3' WHEN l_linenumber = 5 THEN 'bad' ELSE cast(ceil(l_quantity / 5) / 2 AS string) END"
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("string").alias("userId"), F.col("l_partkey").cast("string").alias("movieId"), F.expr(stars).alias("rating"), F.col("at").cast("string").alias("timestamp"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(f"cast({KEY} AS string) AS movieId", f"CASE WHEN {KEY} % 50 = 7 THEN NULL WHEN {KEY} % 40 = 1 THEN cast({KEY} - 1 AS string) ELSE cast({KEY} AS string) END AS tmdbId")


def all_raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"credits": credits(spark, sf_dir), "keywords": keywords(spark, sf_dir), "movies_metadata": movies_metadata(spark, sf_dir), "ratings": ratings(spark, sf_dir)}
