"""Queries of the text sources, the cleaners and the text sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserix.functions import cleaning as C
from tesserix.operators import cleaners
from tesserix.sources import files, raw_roles

from .registry import query, rounded

YEAR = 2019  # the current year of these queries, so that they don't change with the calendar

#: Expected values, straight from the star schema.
M = f"""WITH m AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 97 = 5 THEN NULL ELSE p_partkey END AS id, p_name AS title, p_name AS original_title, p_type || chr(10) || '"' || p_name || '", again' AS overview,
  CASE WHEN p_partkey % 3 = 0 THEN [p_type, p_brand] WHEN p_partkey % 11 = 4 OR p_partkey % 13 = 4 THEN [] ELSE [p_type, p_brand, ''] END AS genres,
  CASE WHEN p_partkey % 5 = 0 THEN [] ELSE [p_brand] END AS production_companies, CASE WHEN p_size % 4 = 0 THEN p_type ELSE '' END AS collection_name,
  CASE WHEN p_partkey % 53 <> 0 THEN make_date(1970 + p_size, 1 + p_partkey % 9, 15) END AS release_date, CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS budget, CAST(-(p_partkey % 3) AS DOUBLE) AS revenue,
  CAST(p_size AS DOUBLE) AS runtime, p_type = 'PROMO' AS adult, CASE WHEN p_size % 3 = 0 THEN 'en' WHEN p_size % 3 = 1 THEN lower(p_brand) END AS original_language,
  CAST(p_partkey % 10 AS DOUBLE) AS vote_average, CAST(p_partkey % 1000 AS DOUBLE) AS vote_count, CAST(NULL AS DOUBLE) AS popularity FROM part),
movies AS (SELECT *, CAST(len(genres) AS INTEGER) AS genre_count, genres[1] AS primary_genre, production_companies[1] AS main_studio, collection_name <> '' AS is_part_of_collection, CAST(year(release_date) AS INTEGER) AS release_year,
  CAST(year(release_date) // 10 * 10 AS INTEGER) AS release_decade, coalesce(original_language = 'en', false) AS is_english FROM m),
credits AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 19 = 3 THEN [] ELSE [p_brand, string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], p_type] END AS actors,
  CASE WHEN p_partkey % 19 = 3 THEN [] ELSE [p_type, p_brand, string_split(p_name, ' ')[2], string_split(p_name, ' ')[1]] END AS lead_actors, CAST(CASE WHEN p_partkey % 19 = 3 THEN 0 ELSE 4 END AS INTEGER) AS cast_size,
  [p_brand, ''] AS directors, [p_type] AS producers, [p_name] AS writers, [CAST(p_size AS VARCHAR)] AS composers FROM part),
keywords AS (SELECT p_partkey AS id, [lower(p_name), lower(p_type)] AS keywords, CAST(2 AS INTEGER) AS keyword_count FROM part),
raw AS (SELECT o_custkey AS userId, l_partkey AS movieId, CASE WHEN l_linenumber = 6 THEN 7.3 WHEN l_linenumber <> 5 THEN ceil(l_quantity / 5) / 2 END AS rating, CAST(year(o_orderdate) AS INTEGER) AS rating_year FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
flagged AS (SELECT *, coalesce(rating <> 7.3, false) AS rating_valid, userId > 0 AS userId_valid, movieId > 0 AS movieId_valid, rating_year <= {YEAR} AS valid_timestamp, count(rating) OVER (PARTITION BY movieId) AS movie_rating_count FROM raw),
clean_ratings AS (SELECT userId, movieId, CAST(rating AS DOUBLE) AS rating, rating_year, movie_rating_count, movie_rating_count >= 5 AS reliable_movie FROM flagged WHERE rating_valid AND userId_valid AND movieId_valid AND valid_timestamp)"""
LISTS = {"genres", "production_companies", "actors", "lead_actors", "directors", "producers", "writers", "composers", "keywords"}


def sql_columns(columns: list[str]) -> str:
    """Lists as text with bars between, so that both engines show them alike."""
    return ", ".join(f"array_to_string({c}, '|') AS {c}" if c in LISTS else f"CAST({c} AS VARCHAR) AS {c}" if c == "release_date" else c for c in columns)


def shown(df, columns: list[str]):
    return df.select([F.array_join(c, "|").alias(c) if c in LISTS else F.col(c).cast("string").alias(c) if c == "release_date" else F.col(c) for c in columns])


def through_csv(spark, name: str, raw):
    """A raw table written as CSV and read back by its reader."""
    folder = files.shared_folder(spark)
    files.write_csv(raw, f"{folder}/{files.RAW.get(name, 'links.csv')}")
    return files.read_csv(spark, f"{folder}/{files.RAW.get(name, 'links.csv')}")


@query("src1_credits_csv", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey % 19 = 3 AS no_cast FROM part")
def _(spark, d):
    return through_csv(spark, "credits", raw_roles.credits(spark, d)).select("id", F.col("cast").isNull().alias("no_cast"))


@query("src2_keywords_csv", "SELECT CAST(p_partkey AS VARCHAR) AS id, '[{\"name\":\"' || upper(p_name) || '\"},{\"name\":\"\"},{\"name\":\"' || p_type || '\"}]' AS keywords FROM part")
def _(spark, d):
    return through_csv(spark, "keywords", raw_roles.keywords(spark, d))


@query("src3_movies_csv", f"{M} SELECT CASE WHEN id IS NULL THEN 'junk' ELSE CAST(id AS VARCHAR) END AS id, title, overview, budget IS NULL AS no_budget FROM m")
def _(spark, d):
    return through_csv(spark, "movies_metadata", raw_roles.movies_metadata(spark, d)).select("id", "title", "overview", F.col("budget").isNull().alias("no_budget"))


@query("src4_ratings_csv", f"{M} SELECT CAST(userId AS VARCHAR) AS userId, CAST(movieId AS VARCHAR) AS movieId, count(*) AS n FROM raw GROUP BY 1, 2")
def _(spark, d):
    return through_csv(spark, "ratings", raw_roles.ratings(spark, d)).groupBy("userId", "movieId").agg(F.count(F.lit(1)).alias("n"))


@query("src7_links_csv", "SELECT p_partkey AS movieId, CASE WHEN p_partkey % 50 = 7 THEN NULL WHEN p_partkey % 40 = 1 THEN p_partkey - 1 ELSE p_partkey END AS tmdbId FROM part")
def _(spark, d):
    folder = files.shared_folder(spark)
    files.write_csv(raw_roles.links(spark, d), f"{folder}/links.csv")
    found = files.optional_csv(spark, files.sibling(f"{folder}/ratings_cleaned.csv", "links"))
    return found.select(C.number(F.col("movieId")).cast("long").alias("movieId"), C.number(F.col("tmdbId")).cast("long").alias("tmdbId"))


def cleaned(spark, d):
    return cleaners.clean(raw_roles.all_raw(spark, d), YEAR)


def rated(spark, d) -> dict:
    """The learners' five tables: cleaned, written and loaded again."""
    folder = files.shared_folder(spark)
    files.write_cleaned(cleaned(spark, d), folder)
    files.write_csv(raw_roles.links(spark, d), f"{folder}/links.csv")
    return files.load_rated(spark, folder)


@query("src8_five_tables", f"""{M} SELECT 'movies' AS name, count(*) AS n FROM m UNION ALL SELECT 'credits', count(*) FROM credits UNION ALL SELECT 'keywords', count(*) FROM keywords
UNION ALL SELECT 'ratings', count(*) FROM clean_ratings UNION ALL SELECT 'links', count(*) FROM part""")
def _(spark, d):
    counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in rated(spark, d).items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("src5_pruned_movies", f"{M} SELECT id, release_year, title FROM movies")
def _(spark, d):
    folder = files.shared_folder(spark)
    files.write_cleaned({"movies_metadata": cleaners.movies(raw_roles.movies_metadata(spark, d), YEAR)}, folder)
    found = files.optional_csv(spark, files.sibling(f"{folder}/ratings_cleaned.csv", "movies"), ["id", "release_year", "title"])
    return found.select(C.number(F.col("id")).cast("long").alias("id"), C.number(F.col("release_year")).cast("int").alias("release_year"), "title")


@query("src6_pruned_ratings", f"{M} SELECT userId, movieId, rating, rating_year, count(*) AS n FROM clean_ratings GROUP BY 1, 2, 3, 4")
def _(spark, d):
    folder = files.shared_folder(spark)
    files.write_cleaned({"ratings": cleaners.ratings(raw_roles.ratings(spark, d), YEAR)}, folder)
    found = files.read_csv(spark, f"{folder}/ratings_cleaned.csv", ["userId", "movieId", "rating", "rating_year"])
    number = lambda c, kind: C.number(F.col(c)).cast(kind).alias(c)
    return found.select(number("userId", "long"), number("movieId", "long"), number("rating", "double"), number("rating_year", "int")).groupBy("userId", "movieId", "rating", "rating_year").agg(F.count(F.lit(1)).alias("n"))


@query("snk1_cleaned_csv", f"{M} SELECT {sql_columns(cleaners.CREDITS)} FROM credits")
def _(spark, d):
    """Cleaned credits, written with their lists as JSON, read and parsed again."""
    folder = files.shared_folder(spark)
    files.write_cleaned({"credits": cleaners.credits(raw_roles.credits(spark, d))}, folder)
    back = files.read_csv(spark, f"{folder}/credits_cleaned.csv")
    lists = {c: C.listed_names(F.col(c)) for c in cleaners.CREDITS if c in LISTS}
    return shown(back.withColumns({**lists, "id": F.col("id").cast("long"), "cast_size": F.col("cast_size").cast("int")}), cleaners.CREDITS)


@query("snk2_feature_names", "SELECT DISTINCT 'genre_' || lower(p_type) AS value FROM part")
def _(spark, d):
    names = raw_roles.table(spark, d, "part").select(F.concat(F.lit("genre_"), F.lower("p_type")).alias("name")).distinct()
    return files.read_lines(spark, files.write_lines(names, "name", f"{files.shared_folder(spark)}/features.txt"))


@query("snk3_table", "SELECT p_type AS feature, CAST(count(*) AS VARCHAR) AS n FROM part GROUP BY 1")
def _(spark, d):
    made = raw_roles.table(spark, d, "part").groupBy(F.col("p_type").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    path = files.write_report(made, f"{files.shared_folder(spark)}/importance.tsv")
    return spark.read.options(header=True, sep="\t", quote='"', escape='"').csv(path)


@query("snk4_report", "SELECT 'ratings  n' AS value UNION ALL SELECT '' || rpad(r, 7, ' ') || '  ' || n FROM (SELECT CAST(CAST(l_linenumber AS INTEGER) AS VARCHAR) AS r, count(*) AS n FROM lineitem GROUP BY 1)")
def _(spark, d):
    made = raw_roles.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("ratings")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(x,) for x in files.report("Lines", made).split("\n")[1:]], "value string").select(F.rtrim(F.regexp_replace("value", "  +", "  ")).alias("value")).select(F.regexp_replace("value", r"^(\d)  ", "$1        ").alias("value"))


@query("cln1_valid_json", "SELECT p_partkey, NOT (p_partkey % 3 = 0 OR p_partkey % 11 = 4) AS valid FROM part")
def _(spark, d):
    part = raw_roles.table(spark, d, "part").select("p_partkey")
    raw = raw_roles.movies_metadata(spark, d).select(F.when(F.col("id") == "junk", None).otherwise(F.col("id")).cast("long").alias("p_partkey"), C.valid_json(F.col("genres")).alias("valid"))
    # rows with junk ids are told apart by their place in the raw table
    odd = raw_roles.table(spark, d, "part").where("p_partkey % 97 = 5").select("p_partkey", C.valid_json(F.expr("CASE WHEN p_partkey % 3 = 0 THEN '[\\'a\\']' WHEN p_partkey % 11 = 4 THEN 'garbage' ELSE '[]' END")).alias("valid"))
    return part.join(raw.where("p_partkey IS NOT NULL").unionByName(odd), "p_partkey")


@query("cln2_parsed_members", f"{M} SELECT id, CAST(len(genres) AS INTEGER) AS n FROM m")
def _(spark, d):
    return cleaners.with_id(raw_roles.movies_metadata(spark, d)).select("id", F.size(C.members(F.col("genres"))).alias("n"))


@query("cln5_invalid_ids", "SELECT count(*) FILTER (p_partkey % 97 = 5 OR p_partkey <= 0) AS invalid FROM part")
def _(spark, d):
    return cleaners.invalid_ids(raw_roles.movies_metadata(spark, d))


@query("cln6_number_flags", f"{M} SELECT id, title, " + ", ".join(f"coalesce({c} >= 0, false) AS {c}_valid" for c in cleaners.NUMBERS) + " FROM m")
def _(spark, d):
    return cleaners.movies_with_flags(raw_roles.movies_metadata(spark, d), YEAR).select("id", "title", *[f"{c}_valid" for c in cleaners.NUMBERS])


@query("cln8_rating_flags", f"{M} SELECT rating_valid, userId_valid, movieId_valid, valid_timestamp, count(*) AS n FROM flagged GROUP BY ALL")
def _(spark, d):
    flags = ["rating_valid", "userId_valid", "movieId_valid", "valid_timestamp"]
    return cleaners.ratings_with_flags(raw_roles.ratings(spark, d), YEAR).groupBy(flags).agg(F.count(F.lit(1)).alias("n"))


@query("cln7_invalid_ratings", f"{M} SELECT count(*) FILTER (rating IS NOT NULL AND NOT rating_valid) AS invalid FROM flagged")
def _(spark, d):
    return cleaners.ratings_with_flags(raw_roles.ratings(spark, d), YEAR).agg(F.count_if(F.col("rating").isNotNull() & ~F.col("rating_valid")).alias("invalid"))


@query("cln10_rating_times", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, CAST(year(o_orderdate) AS INTEGER) AS rating_year, year(o_orderdate) <= 1997 AS valid_timestamp FROM orders")
def _(spark, d):
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    parts = C.time_parts(seconds, 1997)
    return raw_roles.table(spark, d, "orders").select("o_orderkey", F.unix_timestamp(parts["rating_datetime"]).alias("seconds"), parts["rating_year"].alias("rating_year"), parts["valid_timestamp"].alias("valid_timestamp"))


@query("cln11_release_dates", f"{M} SELECT id, title, CAST(release_date AS VARCHAR) AS release_date, release_year, CAST(month(release_date) AS INTEGER) AS release_month, release_decade, coalesce(release_year <= 2001, false) AS release_date_valid FROM movies")
def _(spark, d):
    columns = ["id", "title", "release_date", "release_year", "release_month", "release_decade", "release_date_valid"]
    return shown(cleaners.movies_with_flags(raw_roles.movies_metadata(spark, d), 2001), columns)


@query("cln12_adult", "SELECT p_partkey, p_type = 'PROMO' AS adult FROM part")
def _(spark, d):
    said = F.expr("CASE p_type WHEN 'PROMO' THEN 'True' WHEN 'ECONOMY' THEN 'False' ELSE 'true' END")
    return raw_roles.table(spark, d, "part").select("p_partkey", C.flag(said).alias("adult"))


@query("cln13_language", f"{M} SELECT original_language, is_english, count(*) AS n FROM movies GROUP BY ALL")
def _(spark, d):
    raw = raw_roles.movies_metadata(spark, d).select(C.language(F.col("original_language")).alias("original_language"), C.is_english(F.col("original_language")).alias("is_english"))
    return raw.groupBy("original_language", "is_english").agg(F.count(F.lit(1)).alias("n"))


@query("cln14_defaults", f"{M} SELECT id, 0 AS genre_count, CAST(NULL AS VARCHAR) AS main_studio, '' AS collection_name, CAST(NULL AS DOUBLE) AS budget, CAST(NULL AS INTEGER) AS release_year, false AS adult FROM m")
def _(spark, d):
    """A table of ids alone: all other columns get their defaults."""
    return cleaners.movies(raw_roles.movies_metadata(spark, d).select("id"), YEAR).select("id", "genre_count", "main_studio", "collection_name", "budget", "release_year", "adult")


for _name, _columns, _table in (
    ("arr1_actors", ["id", "actors"], "credits"), ("arr2_lead_actors", ["id", "lead_actors"], "credits"), ("arr3_cast_size", ["id", "cast_size"], "credits"), ("arr4_directors", ["id", "directors"], "credits"),
    ("arr5_producers", ["id", "producers"], "credits"), ("arr6_writers", ["id", "writers"], "credits"), ("arr7_composers", ["id", "composers"], "credits"), ("arr8_keywords", ["id", "keywords", "keyword_count"], "keywords"),
    ("arr9_genres", ["id", "title", "genres", "genre_count", "primary_genre"], "movies"), ("arr10_companies", ["id", "title", "production_companies", "main_studio"], "movies"),
    ("arr11_collections", ["id", "title", "collection_name", "is_part_of_collection"], "movies"), ("flt1_cleaned_movies", cleaners.MOVIES, "movies"),
):
    _made = {"credits": cleaners.credits, "keywords": cleaners.keywords, "movies": lambda raw: cleaners.movies(raw, YEAR)}[_table]
    _raw = {"credits": raw_roles.credits, "keywords": raw_roles.keywords, "movies": raw_roles.movies_metadata}[_table]
    query(_name, f"{M} SELECT {sql_columns(_columns)} FROM {_table}")(lambda spark, d, made=_made, raw=_raw, columns=_columns: shown(made(raw(spark, d)), columns))


@query("arr12_list_literals", "SELECT p_partkey, p_brand || '|' || p_type AS two, p_partkey % 7 = 0 AS broken FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, '', true FROM part WHERE p_partkey % 7 = 0")
def _(spark, d):
    text = F.expr("CASE p_partkey % 7 WHEN 0 THEN '[broken' WHEN 1 THEN concat('[\"', p_brand, '\",\"', p_type, '\",\"x\"]') ELSE concat('[\\'', p_brand, '\\', \\'', p_type, '\\', \\'it\\\\\\'s\\']') END")
    return raw_roles.table(spark, d, "part").select("p_partkey", F.array_join(C.listed_names(text, 2), "|").alias("two"), (F.size(C.listed_names(text)) == 0).alias("broken"))


@query("arr13_first_leads", f"{M} SELECT id, array_to_string(lead_actors[:3], '|') AS leads FROM credits")
def _(spark, d):
    return cleaners.credits(raw_roles.credits(spark, d)).select("id", F.array_join(F.slice("lead_actors", 1, 3), "|").alias("leads"))


@query("arr14_known_words", f"""{M}, v AS (SELECT g FROM (SELECT unnest(lead_actors) AS g FROM credits) GROUP BY 1 ORDER BY count(*) DESC, g LIMIT 5)
SELECT id, array_to_string(list_filter(lead_actors, lambda x: list_contains(words, x)), '|') AS known FROM credits, (SELECT list(g) AS words FROM v)""")
def _(spark, d):
    made = cleaners.credits(raw_roles.credits(spark, d)).select("id", "lead_actors")
    top = made.select(F.explode("lead_actors").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "g").limit(5).agg(F.collect_list("g").alias("v"))
    return made.join(F.broadcast(top), F.lit(True)).select("id", F.array_join(C.known_words(F.col("lead_actors"), F.col("v")), "|").alias("known"))


@query("arr15_joined_keywords", f"{M} SELECT id, array_to_string(keywords, ' ') AS said FROM keywords")
def _(spark, d):
    return cleaners.keywords(raw_roles.keywords(spark, d)).select("id", F.array_join("keywords", " ").alias("said"))


@query("flt2_clean_ratings", f"{M} SELECT userId, movieId, rating, rating_year, movie_rating_count, reliable_movie, count(*) AS n FROM clean_ratings GROUP BY ALL")
def _(spark, d):
    return cleaners.ratings(raw_roles.ratings(spark, d), YEAR).groupBy(cleaners.RATINGS).agg(F.count(F.lit(1)).alias("n"))


@query("agg21_cleaning_summary", f"""{M} SELECT (SELECT count(*) FROM credits) AS credits, (SELECT round(avg(cast_size), 6) FROM credits) AS mean_cast_size, (SELECT count(*) FROM credits) AS with_director, (SELECT count(*) FROM keywords) AS keyword_rows,
CAST(2 AS DOUBLE) AS mean_keywords, (SELECT count(*) FROM m) AS movies, (SELECT count(release_date) FROM m) AS valid_dates, (SELECT count(*) FROM m WHERE budget > 0) AS with_budget, (SELECT count(*) FROM m WHERE revenue > 0) AS with_revenue,
(SELECT count(*) FROM clean_ratings) AS ratings, (SELECT count(DISTINCT userId) FROM clean_ratings) AS users, (SELECT count(DISTINCT movieId) FROM clean_ratings) AS rated_movies, (SELECT count(*) FROM clean_ratings WHERE reliable_movie) AS reliable_ratings,
(SELECT count(DISTINCT a) FROM (SELECT unnest(actors) AS a FROM credits)) AS unique_actors""")
def _(spark, d):
    return rounded(cleaners.summary(cleaned(spark, d)), "mean_cast_size", "mean_keywords")


@query("src12_clean_all", f"{M} SELECT release_decade, count(*) AS n FROM movies GROUP BY 1")
def _(spark, d):
    """All four raw files of a folder cleaned in one go; shown by the movies' decades."""
    folder = files.shared_folder(spark)
    for name, raw in raw_roles.all_raw(spark, d).items():
        files.write_csv(raw, f"{folder}/{files.RAW[name]}")
    return cleaners.clean_all(spark, folder, YEAR)["movies_metadata"].groupBy("release_decade").agg(F.count(F.lit(1)).alias("n"))
