"""Queries of the supervised rating models: feature tables, naive Bayes, importances, the forest, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserix.operators import bayes, features, forest, relational
from tesserix.sources import roles
from tesserix.sources.files import kept

from .catalog import RECOMMENDED, SIMILAR, Split, ratings
from .catalog import SPLIT as CF_SPLIT
from .content_queries import STOP, tfidf_sql
from .registry import query, rounded

NUMERIC, NAMED = ["l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]
K = ", ".join(KEY)
MD5 = "md5(" + " || ':' || ".join(KEY) + " || ':{0}42')"


def rated_lines(spark, d):
    """Order lines as rating rows; their price in cents completes the key."""
    rows = roles.table(spark, d, "lineitem").withColumn("rating", F.ceil(F.col("l_quantity") / 5).cast("double") / 2)
    return rows.withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long")).select(*KEY, "rating", *NUMERIC, *NAMED)


ROWS = f"""WITH rows_ AS (SELECT *, ceil(l_quantity / 5) / 2 AS rating, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
split AS (SELECT *, rn <= ceil(n / 5) AS test, CASE WHEN rn <= (n % 5) * (n // 5 + 1) THEN (rn - 1) // (n // 5 + 1) ELSE n % 5 + (rn - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold
  FROM (SELECT *, row_number() OVER (ORDER BY {MD5.format('')}, {K}) AS rn, count(*) OVER () AS n FROM rows_))"""


def fit_sql(t: str, rows: str) -> str:
    return f""", n{t} AS (SELECT rating, feature, value FROM (SELECT rating, {', '.join(NUMERIC)} FROM {rows}) UNPIVOT (value FOR feature IN ({', '.join(NUMERIC)}))),
g{t} AS (SELECT rating AS label, feature, avg(value) AS mean, var_pop(value) + (SELECT max(v) * 1e-9 FROM (SELECT var_pop(value) AS v FROM n{t} GROUP BY feature)) AS var FROM n{t} GROUP BY 1, 2),
k{t} AS (SELECT rating, feature, value FROM (SELECT rating, {', '.join(NAMED)} FROM {rows}) UNPIVOT (value FOR feature IN ({', '.join(NAMED)}))),
c{t} AS (SELECT label, feature, value, (coalesce(n, 0) + 1) / (total + kinds) AS p FROM (SELECT rating AS label, feature, count(*) AS total FROM k{t} GROUP BY 1, 2)
  JOIN (SELECT feature, value, count(*) OVER (PARTITION BY feature) AS kinds FROM (SELECT DISTINCT feature, value FROM k{t})) USING (feature) LEFT JOIN (SELECT rating AS label, feature, value, count(*) AS n FROM k{t} GROUP BY 1, 2, 3) USING (label, feature, value)),
pr{t} AS (SELECT rating AS label, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM {rows} GROUP BY 1)"""


def predict_sql(t: str, fit: str, rows: str, more: str = "") -> str:
    key = K + more
    return f""", lg{t} AS (SELECT {key}, rating, label, sum(-0.5 * ln(2 * pi() * var) - (value - mean) ** 2 / (2 * var)) AS lg FROM (SELECT {key}, rating, {', '.join(NUMERIC)} FROM {rows}) UNPIVOT (value FOR feature IN ({', '.join(NUMERIC)})) JOIN g{fit} USING (feature) GROUP BY ALL),
lc{t} AS (SELECT {key}, label, sum(ln(p)) AS lc FROM (SELECT {key}, {', '.join(NAMED)} FROM {rows}) UNPIVOT (value FOR feature IN ({', '.join(NAMED)})) JOIN c{fit} USING (feature, value) GROUP BY ALL),
predicted{t} AS (SELECT {key}, rating, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(lg + lc + 2 * prior, 9) DESC, label) AS rn FROM lg{t} JOIN lc{t} USING ({key}, label) JOIN pr{fit} USING (label)) WHERE rn = 1)"""


TRAINED = ROWS + ", fit_rows AS (SELECT * FROM split WHERE NOT test)" + fit_sql("_", "fit_rows") + ", scored_rows AS (SELECT * FROM split)" + predict_sql("_", "_", "scored_rows")


def error_sql(source: str, by: str = "") -> str:
    """Error measures of (by, test, a, p) rows."""
    group = f"GROUP BY {by}" if by else ""
    first = f"{by}, " if by else ""
    return f"""SELECT {first}round(avg((a - p) ** 2), 6) AS mse, round(avg(abs(a - p)), 6) AS mae, round(1 - sum((a - p) ** 2) / nullif(var_pop(a) * count(a), 0), 6) AS r2, round(avg(CAST(abs(a - p) <= 0.5 AS DOUBLE)), 6) AS within_half,
round(avg(CAST(abs(a - p) <= 1 AS DOUBLE)), 6) AS within_one, count(*) FILTER (a >= 3.5 AND p >= 3.5) AS tp, count(*) FILTER (a < 3.5 AND p < 3.5) AS tn, count(*) FILTER (a < 3.5 AND p >= 3.5) AS fp, count(*) FILTER (a >= 3.5 AND p < 3.5) AS fn,
round(avg(CAST((a >= 3.5) = (p >= 3.5) AS DOUBLE)), 6) AS binary_accuracy, round(avg(CAST((CASE WHEN a < 2.5 THEN 0 WHEN a < 4 THEN 1 ELSE 2 END) = (CASE WHEN p < 2.5 THEN 0 WHEN p < 4 THEN 1 ELSE 2 END) AS DOUBLE)), 6) AS class_accuracy,
round(coalesce(count(*) FILTER (a >= ta AND p >= tp_) / nullif(count(*) FILTER (p >= tp_), 0), 0), 6) AS precision_top20, round(coalesce(count(*) FILTER (a >= ta AND p >= tp_) / nullif(count(*) FILTER (a >= ta), 0), 0), 6) AS recall_top20,
round(coalesce(count(*) FILTER (a >= 3.5 AND p >= 3.5) / nullif(count(*) FILTER (p >= 3.5), 0), 0), 6) AS binary_precision, round(coalesce(count(*) FILTER (a >= 3.5 AND p >= 3.5) / nullif(count(*) FILTER (a >= 3.5), 0), 0), 6) AS binary_recall
FROM (SELECT *, quantile_cont(a, 0.8) OVER ({'PARTITION BY ' + by if by else ''}) AS ta, quantile_cont(p, 0.8) OVER ({'PARTITION BY ' + by if by else ''}) AS tp_ FROM {source}) {group}"""


RATIOS = ["mse", "mae", "r2", "within_half", "within_one", "binary_accuracy", "class_accuracy", "precision_top20", "recall_top20", "binary_precision", "binary_recall"]


def predicted(spark, d):
    return bayes.trained(rated_lines(spark, d), KEY, "rating", NUMERIC, NAMED)[1]


@query("smp3_row_split", f"{ROWS} SELECT {K}, test FROM split")
def _(spark, d):
    return relational.row_split(rated_lines(spark, d), *KEY).select(*KEY, "test")


@query("smp7_folds", f"{ROWS} SELECT {K}, CAST(fold AS INTEGER) AS fold FROM split")
def _(spark, d):
    return relational.folds(rated_lines(spark, d), *KEY).select(*KEY, "fold")


@query("smp6_head_sample", f"{ROWS} SELECT {K} FROM rows_ ORDER BY {K} LIMIT 5000")
def _(spark, d):
    return rated_lines(spark, d).select(KEY).orderBy(KEY).limit(5000)


@query("smp8_stratified_folds", "WITH r AS (SELECT ceil(l_quantity / 5) / 2 AS rating FROM lineitem) SELECT rating, count(*) AS n, true AS even FROM r GROUP BY 1")
def _(spark, d):
    """Every fold has its share of each label, give or take one row a part."""
    rows = relational.stratified_folds(rated_lines(spark, d), "rating", *KEY).groupBy("rating", "fold").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("rating").agg(F.sum("n").alias("n"), (F.max("n") - F.min("n") <= 256).alias("even"))


@query("mdl4_label_codes", "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT ceil(l_quantity / 5) / 2 AS label FROM lineitem)")
def _(spark, d):
    return bayes.label_codes(rated_lines(spark, d), "rating")


@query("mdl7_predicted_ratings", f"{TRAINED} SELECT {K}, rating AS actual, predicted, test FROM predicted_ JOIN (SELECT {K}, test FROM split) USING ({K})")
def _(spark, d):
    """All rows by the model of the training part."""
    return predicted(spark, d).select(*KEY, F.col("rating").alias("actual"), "predicted", "test")


@query("mdl10_bayes_training", f"{TRAINED}, e AS (SELECT test, rating AS a, predicted AS p FROM predicted_ JOIN (SELECT {K}, test FROM split) USING ({K})) " + error_sql("e", "test"))
def _(spark, d):
    """Error measures of the training and of the test part."""
    return rounded(bayes.errors(kept(predicted(spark, d).select("rating", "predicted", "test")), "rating", by=["test"]), *RATIOS)


@query("agg16_rating_errors", f"{TRAINED}, e AS (SELECT rating AS a, predicted AS p FROM predicted_ JOIN (SELECT {K}, test FROM split) USING ({K}) WHERE test) " + error_sql("e"))
def _(spark, d):
    return rounded(bayes.errors(kept(predicted(spark, d).where("test").select("rating", "predicted")), "rating"), *RATIOS)


CV = "".join(f", fit{f} AS (SELECT * FROM split WHERE fold <> {f})" + fit_sql(str(f), f"fit{f}") + f", held{f} AS (SELECT * FROM split WHERE fold = {f})" + predict_sql(str(f), str(f), f"held{f}") for f in range(5))


@query("mdl10_bayes_folds", f"{ROWS}{CV} " + " UNION ALL ".join(f"SELECT {f} AS fold, round(avg((rating - predicted) ** 2), 6) AS mse FROM predicted{f}" for f in range(5)))
def _(spark, d):
    return rounded(bayes.cross_validated(rated_lines(spark, d), KEY, "rating", NUMERIC, NAMED), "mse")


IMPORTANCE = """, raw AS (SELECT feature, 'Gaussian_NB' AS model_type, var_pop(mean) / CASE WHEN avg(var) > 1e-10 THEN avg(var) ELSE 1 END AS raw FROM g_ GROUP BY 1
  UNION ALL SELECT feature, 'Categorical_NB', sum(v) FROM (SELECT feature, value, var_pop(p) AS v FROM c_ GROUP BY 1, 2) GROUP BY 1),
importance AS (SELECT feature, model_type, CASE WHEN sum(raw) OVER w > 0 THEN raw / sum(raw) OVER w ELSE 1 / count(*) OVER w END AS importance FROM raw WINDOW w AS (PARTITION BY model_type))"""


def parameters(spark, d):
    train = kept(relational.row_split(rated_lines(spark, d), *KEY)).where("NOT test")
    return bayes.gaussian(train, "rating", NUMERIC), bayes.categorical(train, "rating", NAMED)


@query("imp1_bayes_importance", f"{TRAINED}{IMPORTANCE} SELECT feature, model_type, round(importance, 6) AS importance FROM importance")
def _(spark, d):
    return rounded(bayes.importance(*parameters(spark, d)), "importance")


GROUP_SQL = """CASE WHEN feature LIKE 'genre\\_%' ESCAPE '\\' OR contains(feature, 'primary_genre') THEN 'Genres' WHEN feature LIKE 'keyword\\_%' ESCAPE '\\' THEN 'Keywords' WHEN feature LIKE 'actor\\_%' ESCAPE '\\' OR contains(feature, 'cast_size') THEN 'Actors'
WHEN feature LIKE 'director\\_%' ESCAPE '\\' THEN 'Directors' WHEN feature LIKE 'user\\_%' ESCAPE '\\' THEN 'User Features' WHEN feature LIKE 'rating\\_%' ESCAPE '\\' AND NOT contains(feature, 'count') THEN 'Temporal Features' ELSE 'Movie Metadata' END"""
RENAMED = "CASE feature WHEN 'l_extendedprice' THEN 'budget_log' WHEN 'l_discount' THEN 'rating_delay' WHEN 'l_tax' THEN 'cast_size_filled' WHEN 'l_returnflag' THEN 'genre_drama' ELSE 'primary_genre_clean_encoded' END"


@query("imp4_group_importance", f"""{TRAINED}{IMPORTANCE}, named AS (SELECT {RENAMED} AS feature, importance FROM importance)
SELECT {GROUP_SQL} AS feature_group, round(sum(importance), 6) AS total_importance, count(*) AS feature_count, array_to_string(list(feature ORDER BY round(importance, 9) DESC, feature)[:3], ', ') AS top_features FROM named GROUP BY 1""")
def _(spark, d):
    """Agg20 and srt4 too: sums, counts and first names of groups of features."""
    table = bayes.importance(*parameters(spark, d)).withColumn("feature", F.expr(RENAMED))
    return rounded(bayes.grouped_importance(table), "total_importance")


PERMUTED = f"""{TRAINED}, head AS (SELECT *, row_number() OVER (ORDER BY {K}) AS i FROM (SELECT * FROM rows_ ORDER BY {K} LIMIT 5000)),
each AS (SELECT head.*, f, r FROM head, (SELECT unnest({[*NUMERIC, *NAMED]}) AS f), (SELECT unnest([0, 1, 2, 3, 4]) AS r)),
other AS (SELECT f, r, row_number() OVER (PARTITION BY f, r ORDER BY {MD5.format("' || f || ':' || r || ':")}, {K}) AS i, {', '.join(f'{x} AS o_{x}' for x in [*NUMERIC, *NAMED])} FROM each),
moved AS (SELECT {K}, rating, f, r, {', '.join(f"CASE WHEN f = '{x}' THEN o_{x} ELSE {x} END AS {x}" for x in [*NUMERIC, *NAMED])} FROM each JOIN other USING (f, r, i))"""
PERMUTED += predict_sql("h", "_", "head") + predict_sql("m", "_", "moved", ", f, r")
PERMUTED += """, base AS (SELECT avg((rating - predicted) ** 2) AS base FROM predictedh), loss AS (SELECT f, r, avg((rating - predicted) ** 2) AS mse FROM predictedm GROUP BY 1, 2),
gain AS (SELECT f AS feature, greatest(avg(mse - base), 0) AS importance FROM loss, base GROUP BY 1)"""


@query("imp2_permutation_importance", f"{PERMUTED} SELECT feature, round(importance, 6) AS importance, round(CASE WHEN sum(importance) OVER () > 0 THEN 100 * importance / sum(importance) OVER () ELSE 0 END, 4) AS percent FROM gain")
def _(spark, d):
    rows = rated_lines(spark, d)
    train = kept(relational.row_split(rows, *KEY)).where("NOT test")
    model = kept(bayes.fitted(train, "rating", NUMERIC, NAMED))
    out = bayes.permutation_importance(kept(rows.orderBy(KEY).limit(5000)), model, KEY, "rating", NUMERIC, NAMED)
    return out.select("feature", F.round("importance", 6).alias("importance"), F.round("percent", 4).alias("percent"))


@query("imp5_class_parameters", f"{TRAINED} SELECT feature, label, round(mean, 6) AS mean, round(var, 5) AS var FROM g_ WHERE feature IN ('l_discount', 'l_tax')")
def _(spark, d):
    out = bayes.class_analysis(parameters(spark, d)[0], ["l_discount", "l_tax"])
    return out.select("feature", "label", F.round("mean", 6).alias("mean"), F.round("var", 5).alias("var"))


@query("imp6_worked_example", f"""{TRAINED} SELECT feature, label, round(mean, 6) AS mean, round(avg(mean) OVER (), 6) AS overall_mean, round((mean - avg(mean) OVER ()) ** 2, 9) AS squared_deviation, round(var_pop(mean) OVER (), 9) AS between, round(avg(var) OVER (), 6) AS within
FROM g_ WHERE feature = 'l_discount'""")
def _(spark, d):
    out = bayes.worked_example(parameters(spark, d)[0], "l_discount")
    return rounded(rounded(out, "mean", "overall_mean", "within"), "squared_deviation", "between", to=9)


# The feature tables over rating rows with their films.
F_ = f"""WITH {roles.VIEWS}, {roles.FILMS},
rated AS (SELECT r.userId, r.rating, r.rating_year, f.* FROM ratings r JOIN films f ON r.movieId = f.id WHERE release_year >= 2000),
seen AS (SELECT DISTINCT id FROM rated), some_films AS (SELECT * FROM films WHERE id IN (FROM seen))"""


def film_rows(spark, d):
    """(rating rows with their films, the films of these rows)."""
    parts = roles.film_parts(spark, d)
    rows = features.merged(ratings(spark, d), parts["movies"], parts["credits"], parts["keywords"])
    films = parts["movies"].join(parts["credits"], "id", "left").join(parts["keywords"], "id", "left").join(rows.select(F.col("movieId").alias("id")), "id", "left_semi")
    return rows, films


def top_flags_sql(source: str, prefix: str, top: int) -> str:
    return f"""SELECT DISTINCT id, '{prefix}' || regexp_replace(lower(v), '[^\\p{{L}}\\p{{N}}_]', '_', 'g') AS feature FROM (SELECT id, unnest({source}) AS v FROM some_films)
WHERE v IN (SELECT v FROM (SELECT unnest({source}) AS v FROM rated) WHERE v <> '' GROUP BY 1 ORDER BY count(*) DESC, v LIMIT {top})"""


@query("jn3_rating_rows", f"{F_} SELECT userId, id AS movieId, rating, title, cast_size, CAST(len(keywords) AS INTEGER) AS keywords FROM rated")
def _(spark, d):
    """Ratings with their films, credits and keywords (jn4, jn5), from 2000 on (flt5)."""
    rows = film_rows(spark, d)[0]
    return rows.select("userId", "movieId", "rating", "title", "cast_size", F.coalesce(F.size("keywords"), F.lit(0)).alias("keywords"))


for _name, _source, _prefix, _top, _made in (
    ("fe7_genre_columns", "genres", "genre_", 15, features.genre_flags), ("fe9_actor_columns", "lead_actors[:5]", "actor_", 20, features.actor_flags), ("fe9_director_columns", "directors", "director_", 10, features.director_flags),
):
    query(_name, f"{F_} {top_flags_sql(_source, _prefix, _top)}")(lambda spark, d, made=_made: made(*film_rows(spark, d)))

KEYWORD_TEXT = "array_to_string(keywords[:10], ' ')"


@query("fe10_keyword_columns", f"""{F_}, t AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower({KEYWORD_TEXT}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS t FROM some_films) WHERE t NOT IN ('the', 'of', 'and') GROUP BY 1, 2)
SELECT id, 'keyword_' || t AS feature FROM t WHERE t IN (SELECT t FROM t GROUP BY 1 ORDER BY sum(tf) DESC, t LIMIT 25)""")
def _(spark, d):
    return features.keyword_flags(film_rows(spark, d)[1], stop=STOP)


@query("fe11_keyword_tfidf", F_ + tfidf_sql("x", "some_films", KEYWORD_TEXT, 1.0, "keyword_", 25, 1, 1.0) + " SELECT id, feature, round(value, 6) AS value FROM x")
def _(spark, d):
    return rounded(features.keyword_tfidf(film_rows(spark, d)[1], stop=STOP), "value")


NUMBERS = ["release_year_filled", "runtime_filled", "vote_average_filled", "popularity_filled", "budget_log", "revenue_log", "vote_count_log", "profit_log", "roi", "movie_age"]
FILLED = f"""{F_}, mids AS (SELECT median(release_year) AS y, median(runtime) AS t, median(vote_average) AS v, median(popularity) AS p FROM rated),
n AS (SELECT userId, id AS movieId, rating_year, release_year, coalesce(release_year, y) AS release_year_filled, coalesce(runtime, t) AS runtime_filled, coalesce(vote_average, v) AS vote_average_filled, coalesce(popularity, p) AS popularity_filled,
  coalesce(budget, 0) AS budget, coalesce(revenue, 0) AS revenue, coalesce(vote_count, 0) AS vote_count, coalesce(cast_size, 0) AS cast_size_filled, CAST(adult AS INTEGER) AS adult_clean FROM rated, mids)"""


@query("fe12_film_numbers", f"""{FILLED} SELECT userId, movieId, {', '.join(f'round({c}, 6) AS {c}' for c in NUMBERS[:4])}, {', '.join(f'round(ln(1 + {c}), 6) AS {c}_log' for c in ('budget', 'revenue', 'vote_count'))},
round(ln(1 + greatest(revenue - budget, 0)), 6) AS profit_log, round(CASE WHEN budget > 0 THEN (revenue - budget) / budget ELSE 0 END, 6) AS roi, round(2025 - release_year_filled, 6) AS movie_age, cast_size_filled, adult_clean FROM n""")
def _(spark, d):
    """Agg14 too: medians over the rating rows fill what is missing."""
    return rounded(features.numbers(film_rows(spark, d)[0]), *NUMBERS).select("userId", "movieId", *NUMBERS, "cast_size_filled", "adult_clean")


@query("fe12_codes", f"{F_} SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT coalesce(original_language, 'unknown') AS value FROM rated)")
def _(spark, d):
    return features.codes(film_rows(spark, d)[0], "original_language")


@query("fe12_delays", f"{FILLED} SELECT userId, movieId, round(rating_year - release_year_filled, 6) AS rating_delay, CAST(greatest(rating_year - release_year, 0) AS DOUBLE) AS rating_delay_clipped FROM n")
def _(spark, d):
    return rounded(features.delays(features.numbers(film_rows(spark, d)[0])), "rating_delay").select("userId", "movieId", "rating_delay", "rating_delay_clipped")


@query("fe12_moments", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS rating_year, CAST(month(o_orderdate) AS INTEGER) AS rating_month, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS rating_day_of_week, CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS is_weekend FROM orders")
def _(spark, d):
    return roles.table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in features.moment_parts(F.col("o_orderdate")).items()])


TYPES = {"budget_log": "double", "roi": "double", "movie_age": "double", "original_language_clean_encoded": "tinyint", "adult_clean": "int", "genre_drama": "int", "keyword_war": "int", "keyword_country": "int", "rating_year": "bigint", "title": "string", "user_rating_mean": "double", "actor_x": "int"}


@query("fe13_routing", "SELECT * FROM (VALUES ('budget_log', 'gaussian'), ('roi', 'gaussian'), ('movie_age', 'gaussian'), ('rating_year', 'gaussian'), ('user_rating_mean', 'gaussian'), ('original_language_clean_encoded', 'categorical'), ('adult_clean', 'categorical'), ('genre_drama', 'categorical'), ('keyword_war', 'categorical'), ('actor_x', 'categorical')) t(feature, family)")
def _(spark, d):
    """Prj2 too: columns chosen by their names and types."""
    return spark.createDataFrame([(name, family) for family, names in features.routed(TYPES).items() for name in names], "feature string, family string")


@query("agg10_user_stats", f"""WITH {roles.VIEWS} SELECT userId, round(avg(rating), 3) AS user_rating_mean, round(coalesce(stddev_samp(rating), 0), 3) AS user_rating_std, count(rating) AS user_rating_count, min(rating_year) AS user_first_year, max(rating_year) AS user_last_year,
CAST(max(rating_year) - min(rating_year) AS DOUBLE) AS user_rating_span FROM ratings GROUP BY 1""")
def _(spark, d):
    return features.user_stats(ratings(spark, d))


@query("agg11_user_spans", "SELECT o_custkey AS userId, round(avg(o_totalprice), 8) AS user_rating_mean, count(*) AS user_rating_count, round(CAST(max(epoch(o_orderdate)) - min(epoch(o_orderdate)) AS DOUBLE) / (24 * 3600 * 365), 6) AS user_rating_span FROM orders GROUP BY 1")
def _(spark, d):
    rows = roles.table(spark, d, "orders").select(F.col("o_custkey").alias("userId"), F.col("o_totalprice").alias("rating"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp"))
    return features.user_stats(rows, None).select("userId", F.round("user_rating_mean", 8).alias("user_rating_mean"), "user_rating_count", F.round("user_rating_span", 6).alias("user_rating_span"))


@query("jn6_user_stats_on_rows", f"WITH {roles.VIEWS} SELECT userId, movieId, rating, round(avg(rating) OVER (PARTITION BY userId), 3) AS user_rating_mean, count(*) OVER (PARTITION BY userId) AS user_rating_count FROM ratings")
def _(spark, d):
    rows = ratings(spark, d)
    return rows.join(features.user_stats(rows).select("userId", "user_rating_mean", "user_rating_count"), "userId").select("userId", "movieId", "rating", "user_rating_mean", "user_rating_count")


@query("agg19_history_genres", f"""{F_}, h AS (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY md5(userId || ':' || id || ':42'), id) <= count(*) OVER (PARTITION BY userId) * 7 // 10 OR count(*) OVER (PARTITION BY userId) < 5 AS history FROM rated),
m AS (SELECT userId, genre, avg(rating) AS mean, count(*) AS n FROM (SELECT userId, rating, unnest(list_distinct(genres)) AS genre FROM h WHERE history) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT userId, genre, round(mean, 6) AS mean, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY round(mean, 9) DESC, genre) AS rank FROM m) WHERE rank <= 3""")
def _(spark, d):
    """The genres, of each film's whole list, that users liked best in the part of their histories that is shown."""
    from pyspark.sql import Window as W

    own = W.partitionBy("userId")
    rows = film_rows(spark, d)[0].withColumns({"rn": F.row_number().over(own.orderBy(relational.shuffled("userId", "movieId"), "movieId")), "n": F.count(F.lit(1)).over(own)}).where("n < 5 OR rn <= n * 7 div 10")
    by = rows.select("userId", "rating", F.explode("genres").alias("genre")).groupBy("userId", "genre").agg(F.avg("rating").alias("mean"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    rank = F.row_number().over(own.orderBy(F.desc(F.round("mean", 9)), "genre"))
    return rounded(by.withColumn("rank", rank).where("rank <= 3"), "mean")


CF = f"WITH {roles.VIEWS}{CF_SPLIT}"
DEMO = """, demo AS (SELECT userId FROM (SELECT userId FROM halves GROUP BY 1 HAVING count(*) >= 10) ORDER BY md5(userId || ':demo:42'), userId LIMIT 5)"""


def demo_users(test, n: int = 5, least: int = 10):
    often = test.groupBy("userId").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least)
    return often.orderBy(relational.shuffled("userId", F.lit("demo")), "userId").limit(n).select("userId")


@query("smp5_demo_users", f"{CF}{DEMO} SELECT userId FROM demo")
def _(spark, d):
    """Flt13 too: users with ten rows or more."""
    return demo_users(Split(spark, d).test)


@query("srt2_favourites", f"""{CF}, f AS (SELECT userId, movieId, rating, row_number() OVER (PARTITION BY userId ORDER BY rating DESC, movieId) AS place FROM halves WHERE known AND rating >= 3.5)
SELECT userId, movieId, coalesce(p_name, 'ID:' || movieId) AS title, rating, CAST(place AS INTEGER) AS place FROM f LEFT JOIN part ON p_partkey = movieId AND p_partkey % 10 > 0 WHERE place <= 5""")
def _(spark, d):
    """The five best liked known films of every test user, with their titles (jn13); some have none."""
    return favourites(Split(spark, d).test.where("known"), titles(spark, d))


def titles(spark, d):
    return roles.movies(spark, d).where("id % 10 > 0").select(F.col("id").alias("movieId"), "title")


def titled(df, names):
    return df.join(names, "movieId", "left").withColumn("title", F.coalesce("title", F.concat(F.lit("ID:"), F.col("movieId").cast("string"))))


def favourites(known, names, most: int = 5):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("userId").orderBy(F.desc("rating"), "movieId"))
    best = known.where(F.col("rating") >= relational.LIKED).withColumn("place", place).where(F.col("place") <= most)
    return titled(best, names).select("userId", "movieId", "title", "rating", "place")


@query("evl6_inspection", f"""{CF}{SIMILAR}{RECOMMENDED}{DEMO}, lines AS (
  SELECT userId, 'favourite' AS kind, movieId, rating, row_number() OVER (PARTITION BY userId ORDER BY rating DESC, movieId) AS place FROM halves WHERE known AND rating >= 3.5
  UNION ALL SELECT userId, 'recommended', movieId, NULL, rank FROM recs
  UNION ALL SELECT userId, 'watched', movieId, rating, row_number() OVER (PARTITION BY userId ORDER BY rating DESC, movieId) FROM halves WHERE NOT known)
SELECT userId, kind, movieId, coalesce(p_name, 'ID:' || movieId) AS title, rating, CAST(place AS INTEGER) AS place FROM lines LEFT JOIN part ON p_partkey = movieId AND p_partkey % 10 > 0 WHERE place <= 5 AND userId IN (FROM demo)""")
def _(spark, d):
    from pyspark.sql import Window as W

    split, names = Split(spark, d), titles(spark, d)
    some = demo_users(split.test)
    mine = lambda df: df.join(F.broadcast(some), "userId", "left_semi")
    order = F.row_number().over(W.partitionBy("userId").orderBy(F.desc("rating"), "movieId"))
    best = favourites(mine(split.test.where("known")), names).withColumn("kind", F.lit("favourite"))
    recs = titled(mine(split.recommended()).where("rank <= 5"), names).select("userId", "movieId", "title", F.lit(None).cast("double").alias("rating"), F.col("rank").alias("place"), F.lit("recommended").alias("kind"))
    seen = titled(mine(split.test.where("NOT known")).withColumn("place", order).where("place <= 5"), names).withColumn("kind", F.lit("watched")).select(best.columns)
    return best.unionByName(recs).unionByName(seen).select("userId", "kind", "movieId", "title", "rating", "place")


@query("evl5_user_reports", f"""{TRAINED}, e AS (SELECT o_custkey AS userId, rating AS a, predicted AS p FROM predicted_ JOIN (SELECT {K}, test FROM split) USING ({K}) JOIN orders ON o_orderkey = l_orderkey WHERE test),
often AS (SELECT * FROM e WHERE userId IN (SELECT userId FROM e GROUP BY 1 HAVING count(*) >= 10)) """ + error_sql("often", "userId"))
def _(spark, d):
    """Error measures of every user with ten held-out rows or more."""
    users = roles.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("userId"))
    rows = kept(predicted(spark, d).where("test").join(users, "l_orderkey").select("userId", "rating", "predicted"))
    return rounded(bayes.errors(relational.at_least(rows, "userId", 10), "rating", by=["userId"]), *RATIOS)


@query("srt3_sorted_histories", f"""{TRAINED}, e AS (SELECT o_custkey AS userId, l_partkey AS movieId, {K.replace('l_partkey, ', '')}, rating, predicted, test FROM predicted_ JOIN (SELECT {K}, test FROM split) USING ({K}) JOIN orders ON o_orderkey = l_orderkey)
SELECT userId, movieId, rating, predicted, test, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY userId, test ORDER BY CASE WHEN test THEN predicted ELSE rating END DESC, movieId, l_orderkey, l_linenumber, l_suppkey, cents) AS place FROM e) WHERE place <= 5""")
def _(spark, d):
    """A user's five best rated known rows, and the five best predicted held-out ones (evl7 shows them for the demo users)."""
    from pyspark.sql import Window as W

    users = roles.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("userId"))
    rows = predicted(spark, d).join(users, "l_orderkey").withColumnRenamed("l_partkey", "movieId")
    worth = F.when(F.col("test"), F.col("predicted")).otherwise(F.col("rating"))
    place = F.row_number().over(W.partitionBy("userId", "test").orderBy(F.desc(worth), "movieId", "l_orderkey", "l_linenumber", "l_suppkey", "cents"))
    return rows.withColumn("place", place).where("place <= 5").select("userId", "movieId", "rating", "predicted", "test", "place")


@query("srt1_popularity_list", f"{CF} SELECT movieId, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, movieId) AS INTEGER) AS place FROM popular ORDER BY place LIMIT 100")
def _(spark, d):
    """The hundred most popular films."""
    from pyspark.sql import Window as W

    from tesserix.operators import collaborative

    best = collaborative.popularity(collaborative.movie_stats(Split(spark, d).train)).orderBy(F.desc(F.round("score", 9)), "movieId").limit(100)
    return rounded(best.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "movieId"))), "score")


#: The queries' forests are smaller than the operator's own default of 100 trees of depth 20, which takes minutes on a single machine.
SMALL = {"trees": 10, "depth": 8}


def forest_parts(spark, d):
    """(training rows, test rows), written once."""
    rows = kept(relational.row_split(rated_lines(spark, d), *KEY))
    return rows.where("NOT test"), rows.where("test")


@query("mdl9_forest_predictions")
def _(spark, d):
    """The test rows by a forest of the training rows."""
    train, test = forest_parts(spark, d)
    return forest.predict(test, forest.fit(train, "rating", NUMERIC, NAMED, **SMALL), "rating").select(*KEY, "rating", "predicted")


@query("mdl11_forest_training")
def _(spark, d):
    """Error measures on the training and on the test part."""
    train, test = forest_parts(spark, d)
    model = forest.fit(train, "rating", NUMERIC, NAMED, **SMALL)
    return bayes.errors(kept(forest.predict(train.unionByName(test), model, "rating").select("rating", "predicted", "test")), "rating", by=["test"])


@query("imp3_forest_importance")
def _(spark, d):
    train, _ = forest_parts(spark, d)
    return forest.importance(train, forest.fit(train, "rating", NUMERIC, NAMED, **SMALL))
