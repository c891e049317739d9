"""All registered queries of the recommendation engine, with the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserix.functions import cleaning as C
from tesserix.operators import bayes, collaborative, relational
from tesserix.sources import roles
from tesserix.sources.files import kept

from .registry import QUERIES, SQL, Query, query, rounded

def ratings(spark: SparkSession, d: str) -> DataFrame:
    return relational.deduplicated(relational.mapped(roles.ratings_raw(spark, d), roles.links(spark, d)))


R = f"WITH {roles.VIEWS}"
SPLIT = """, recent AS (SELECT * FROM ratings WHERE movieId IN (SELECT p_partkey FROM part WHERE p_size + 1970 >= 2000)),
ranked_users AS (SELECT userId, row_number() OVER (ORDER BY md5(userId || ':42'), userId) AS rn, count(*) OVER () AS n
  FROM (SELECT DISTINCT userId FROM recent ORDER BY md5(userId || ':42'), userId LIMIT 10000)),
users AS (SELECT userId, rn <= floor(n * 4 / 5) AS train FROM ranked_users),
train AS (SELECT r.* FROM recent r JOIN users USING (userId) WHERE train),
test AS (SELECT r.*, row_number() OVER (PARTITION BY userId ORDER BY rating_year, movieId) AS rn, count(*) OVER (PARTITION BY userId) AS n FROM recent r JOIN users USING (userId) WHERE NOT train),
halves AS (SELECT *, CASE WHEN n >= 5 THEN rn <= n * 4 // 5 WHEN n >= 2 THEN rn < n ELSE true END AS known FROM test),
stats AS (SELECT movieId, count(rating) AS rating_count, avg(rating) AS rating_avg FROM train GROUP BY 1),
globals AS (SELECT avg(rating_avg) AS c, quantile_cont(rating_count, 0.9) AS m FROM stats),
popular AS (SELECT movieId, rating_count / (rating_count + m) * rating_avg + m / (rating_count + m) * c AS score FROM stats, globals)"""
SIMILAR = """, sizes AS (SELECT movieId, sqrt(sum(rating * rating)) AS norm, count(*) AS cnt FROM train GROUP BY 1 HAVING count(*) >= 5),
active AS (SELECT t.* FROM train t JOIN sizes USING (movieId)),
dots AS (SELECT a.movieId AS m1, b.movieId AS m2, sum(a.rating * b.rating) AS dot FROM active a JOIN active b ON a.userId = b.userId AND a.movieId <> b.movieId GROUP BY 1, 2),
scored AS (SELECT m1, m2, dot / (x.norm * y.norm) / ln(y.cnt + 2) AS score FROM dots JOIN sizes x ON m1 = x.movieId JOIN sizes y ON m2 = y.movieId),
similar_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m1 ORDER BY round(score, 9) DESC, m2) AS rank FROM scored WHERE score >= 0.01) WHERE rank <= 20)"""
RECOMMENDED = """, seeds AS (SELECT userId, movieId, rating FROM halves WHERE known AND rating >= 3.5),
cand AS (SELECT userId, m2 AS movieId, sum(score * rating) AS score FROM seeds JOIN similar_ ON movieId = m1 GROUP BY 1, 2),
found AS (SELECT * FROM (SELECT userId, movieId, row_number() OVER (PARTITION BY userId ORDER BY round(score, 9) DESC, movieId) AS rank
  FROM cand c WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.userId = c.userId AND s.movieId = c.movieId)) WHERE rank <= 15),
places AS (SELECT movieId, row_number() OVER (ORDER BY round(score, 9) DESC, movieId) AS place FROM popular),
fill AS (SELECT u.userId, p.movieId, row_number() OVER (PARTITION BY u.userId ORDER BY place) + (SELECT count(*) FROM found f WHERE f.userId = u.userId) AS rank
  FROM (SELECT DISTINCT userId FROM halves WHERE known) u, places p
  WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.userId = u.userId AND s.movieId = p.movieId) AND NOT EXISTS (SELECT 1 FROM found f WHERE f.userId = u.userId AND f.movieId = p.movieId)),
recs AS (SELECT userId, movieId, CAST(rank AS INTEGER) AS rank, false AS fallback FROM found UNION ALL SELECT userId, movieId, CAST(rank AS INTEGER), true FROM fill WHERE rank <= 15)"""
HIDDEN = """, hidden AS (SELECT * FROM halves WHERE NOT known),
pairs AS (SELECT coalesce(r.userId, h.userId) AS userId, r.movieId AS rec, h.movieId AS act, h.rating FROM recs r FULL JOIN hidden h ON r.userId = h.userId AND r.movieId = h.movieId),
counted AS (SELECT userId, count(*) FILTER (rec IS NOT NULL AND act IS NOT NULL) AS tp, count(*) FILTER (rec IS NOT NULL AND act IS NULL) AS fp, count(*) FILTER (rec IS NULL AND act IS NOT NULL) AS fn,
  count(*) FILTER (rec IS NOT NULL AND rating >= 3.5) AS e_tp, count(*) FILTER (rec IS NULL AND rating >= 3.5) AS e_fn FROM pairs GROUP BY 1),
universe AS (SELECT count(DISTINCT movieId) AS movies FROM recent),
metrics AS (SELECT userId, tp, fp, fn, movies - tp - fp - fn AS tn, e_tp, tp + fp - e_tp AS e_fp, e_fn, movies - tp - fp - e_fn AS e_tn, (movies - fp - fn) / movies AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
  2 * tp / (2 * tp + fp + fn) AS f1, CAST(tp > 0 AS DOUBLE) AS hit_rate, e_tp / (tp + fp) AS enjoyment_precision, coalesce(e_tp / nullif(e_tp + e_fn, 0), 0) AS enjoyment_recall, 2 * e_tp / (tp + fp + e_tp + e_fn) AS enjoyment_f1
  FROM counted, universe WHERE tp + fp > 0 AND tp + fn > 0)"""
COUNTS = ["tp", "fp", "fn", "tn", "e_tp", "e_fp", "e_fn", "e_tn"]
METRICS = ["accuracy", "precision", "recall", "f1", "hit_rate", "enjoyment_precision", "enjoyment_recall", "enjoyment_f1"]


class Split:
    """Recent ratings, the training users' part and the test users' histories. Several steps read the recent ratings, so they are written once."""

    def __init__(self, spark: SparkSession, d: str):
        self.recent = kept(relational.since(ratings(spark, d), roles.movies(spark, d)))
        users = relational.sampled_users(self.recent)
        self.train = self.recent.join(users.where("train"), "userId").drop("train")
        self.test = relational.known_and_hidden(self.recent.join(users.where("NOT train"), "userId").drop("train"))

    def recommended(self) -> DataFrame:
        # several steps read both parts
        train, test = kept(self.train), kept(self.test)
        return collaborative.recommend(test.where("known"), collaborative.similarity(train), collaborative.popularity(collaborative.movie_stats(train)))

    def metrics(self) -> DataFrame:
        return collaborative.user_metrics(self.recommended(), self.test.where("NOT known"), self.recent.agg(F.countDistinct("movieId").alias("movies")))


@query("jn1_mapped_ratings", f"{R} SELECT userId, tmdbId AS movieId, rating, rating_year FROM ratings_raw JOIN links USING (movieId) WHERE tmdbId IS NOT NULL")
def _(spark, d):
    return relational.mapped(roles.ratings_raw(spark, d), roles.links(spark, d)).select("userId", "movieId", "rating", "rating_year")


@query("agg2_deduplicated_ratings", f"{R} SELECT * FROM ratings")
def _(spark, d):
    return ratings(spark, d)


@query("flt3_recent_ratings", f"{R}{SPLIT} SELECT * FROM recent")
def _(spark, d):
    return relational.since(ratings(spark, d), roles.movies(spark, d))


@query("flt8_active_users", f"{R} SELECT * FROM ratings WHERE userId IN (SELECT userId FROM ratings GROUP BY 1 HAVING count(*) >= 30)")
def _(spark, d):
    return relational.at_least(ratings(spark, d), "userId", 30)


@query("flt9_reliable_ratings", f"""{R}, early AS (SELECT * FROM ratings WHERE userId IN (SELECT DISTINCT userId FROM ratings ORDER BY 1 LIMIT 1000))
SELECT * FROM early WHERE movieId IN (SELECT movieId FROM early GROUP BY 1 HAVING count(*) >= 30) AND userId IN (SELECT userId FROM early GROUP BY 1 HAVING count(*) >= 30)""")
def _(spark, d):
    return relational.reliable(ratings(spark, d), 1000, 30, 30).select("userId", "movieId", "rating", "rating_year")


@query("flt8_active_users_10", f"{R} SELECT * FROM ratings WHERE userId IN (SELECT userId FROM ratings GROUP BY 1 HAVING count(*) >= 10)")
def _(spark, d):
    return relational.at_least(ratings(spark, d), "userId", 10)


@query("flt9_reliable_ratings_5000", f"""{R}, early AS (SELECT * FROM ratings WHERE userId IN (SELECT DISTINCT userId FROM ratings ORDER BY 1 LIMIT 5000))
SELECT * FROM early WHERE movieId IN (SELECT movieId FROM early GROUP BY 1 HAVING count(*) >= 5) AND userId IN (SELECT userId FROM early GROUP BY 1 HAVING count(*) >= 10)""")
def _(spark, d):
    return relational.reliable(ratings(spark, d)).select("userId", "movieId", "rating", "rating_year")


@query("flt13_eligible_users", f"{R} SELECT userId, count(*) AS user_count FROM ratings GROUP BY 1 HAVING count(*) >= 10")
def _(spark, d):
    """AGG12 too: users with their numbers of ratings, ten or more."""
    return ratings(spark, d).groupBy("userId").agg(F.count(F.lit(1)).alias("user_count")).where("user_count >= 10")


@query("agg13_distinct_counts", f"{R} SELECT count(*) AS n, count(DISTINCT userId) AS users, count(DISTINCT movieId) AS movies FROM ratings")
def _(spark, d):
    return ratings(spark, d).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("userId").alias("users"), F.countDistinct("movieId").alias("movies"))


@query("flt11_liked", f"{R} SELECT * FROM ratings WHERE rating >= 3.5")
def _(spark, d):
    return ratings(spark, d).where(F.col("rating") >= relational.LIKED)


@query("smp2_user_split", f"{R}{SPLIT} SELECT userId, train FROM users")
def _(spark, d):
    return relational.sampled_users(relational.since(ratings(spark, d), roles.movies(spark, d)))


@query("smp4_user_row_split", f"""{R} SELECT userId, movieId, n >= 5 AND row_number() OVER (PARTITION BY userId ORDER BY md5(userId || ':' || movieId || ':42'), movieId) > n * 7 // 10 AS held
FROM (SELECT *, count(*) OVER (PARTITION BY userId) AS n FROM ratings)""")
def _(spark, d):
    own = W.partitionBy("userId")
    rows = ratings(spark, d).withColumns({"n": F.count(F.lit(1)).over(own), "rn": F.row_number().over(own.orderBy(relational.shuffled("userId", "movieId"), "movieId"))})
    return rows.select("userId", "movieId", F.expr("n >= 5 AND rn > n * 7 div 10").alias("held"))


@query("win1_known_and_hidden", f"{R}{SPLIT} SELECT userId, movieId, rating, rating_year, known FROM halves")
def _(spark, d):
    return Split(spark, d).test


@query("agg1_movie_rating_counts", """SELECT l_orderkey, l_linenumber, l_partkey, count(l_quantity) OVER (PARTITION BY l_partkey) AS movie_rating_count,
count(l_quantity) OVER (PARTITION BY l_partkey) >= 30 AS reliable_movie FROM lineitem""")
def _(spark, d):
    n = F.count("l_quantity").over(W.partitionBy("l_partkey"))
    return roles.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", n.alias("movie_rating_count"), (n >= 30).alias("reliable_movie"))


@query("win8_language_codes", "SELECT p_brand AS language, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_brand FROM part)")
def _(spark, d):
    return roles.movies(spark, d).select(F.col("original_language").alias("language")).distinct().withColumn("code", F.dense_rank().over(W.orderBy("language")) - 1)


@query("agg3_movie_stats", f"{R}{SPLIT} SELECT movieId, rating_count, round(rating_avg, 6) AS rating_avg FROM stats")
def _(spark, d):
    return rounded(collaborative.movie_stats(Split(spark, d).train), "rating_avg")


@query("agg4_popularity_globals", f"{R}{SPLIT} SELECT round(c, 6) AS c, m FROM globals")
def _(spark, d):
    return rounded(collaborative.popularity_globals(collaborative.movie_stats(Split(spark, d).train)), "c")


@query("agg5_popularity", f"{R}{SPLIT} SELECT movieId, round(score, 6) AS score FROM popular")
def _(spark, d):
    return rounded(collaborative.popularity(collaborative.movie_stats(Split(spark, d).train)), "score")


@query("agg6_item_norms", f"{R}{SPLIT} SELECT movieId, round(sqrt(sum(rating * rating)), 6) AS norm, count(*) AS rating_count FROM train GROUP BY 1")
def _(spark, d):
    return rounded(collaborative.norms(Split(spark, d).train), "norm")


@query("agg7_pair_dots", f"{R}{SPLIT} SELECT a.movieId AS m1, b.movieId AS m2, sum(a.rating * b.rating) AS dot FROM train a JOIN train b ON a.userId = b.userId AND a.movieId < b.movieId GROUP BY 1, 2")
def _(spark, d):
    return collaborative.co_ratings(Split(spark, d).train)


@query("mdl1_similar_items", f"{R}{SPLIT}{SIMILAR} SELECT m1 AS movieId, m2 AS other, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM similar_")
def _(spark, d):
    return rounded(collaborative.similarity(Split(spark, d).train), "score")


@query("mdl2_cf_recommendations", f"{R}{SPLIT}{SIMILAR}{RECOMMENDED} SELECT * FROM recs")
def _(spark, d):
    return Split(spark, d).recommended()


@query("evl1_user_metrics", f"{R}{SPLIT}{SIMILAR}{RECOMMENDED}{HIDDEN} SELECT userId, {', '.join(COUNTS)}, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM metrics")
def _(spark, d):
    return rounded(Split(spark, d).metrics(), *METRICS).select("userId", *COUNTS, *METRICS)


@query("evl2_macro_metrics", f"{R}{SPLIT}{SIMILAR}{RECOMMENDED}{HIDDEN} SELECT count(*) AS users, round(count(*) / (SELECT count(DISTINCT userId) FROM test), 6) AS success_rate, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS) + " FROM metrics")
def _(spark, d):
    split = Split(spark, d)
    tested = split.test.agg(F.countDistinct("userId").alias("tested"))
    return split.metrics().join(F.broadcast(tested), F.lit(True)).agg(F.count(F.lit(1)).alias("users"), F.round(F.count(F.lit(1)) / F.first("tested"), 6).alias("success_rate"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


@query("agg18_rating_distribution", f"{R} SELECT rating, count(*) AS n FROM ratings GROUP BY 1")
def _(spark, d):
    return ratings(spark, d).groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


@query("agg19_favourite_genres", f"""{R}, liked AS (SELECT userId, p_type AS genre, avg(rating) AS mean, count(*) AS n FROM ratings JOIN part ON movieId = p_partkey GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT userId, genre, round(mean, 6) AS mean, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY round(mean, 9) DESC, genre) AS rank FROM liked) WHERE rank <= 3""")
def _(spark, d):
    genres = roles.movies(spark, d).select(F.col("id").alias("movieId"), F.col("primary_genre").alias("genre"))
    by = ratings(spark, d).join(genres, "movieId").groupBy("userId", "genre").agg(F.avg("rating").alias("mean"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    rank = F.row_number().over(W.partitionBy("userId").orderBy(F.desc(F.round("mean", 9)), "genre"))
    return rounded(by.withColumn("rank", rank).where("rank <= 3"), "mean")


@query("cln_event_ids", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS movieId, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) > 0, false) AS valid_id,
CAST(year(ts) AS INTEGER) AS rating_year FROM events""")
def _(spark, d):
    k = C.number(F.get_json_object("props", "$.k")).cast("long")
    return roles.table(spark, d, "events").select("event_id", k.alias("movieId"), C.valid_id(k).alias("valid_id"), F.year("ts").alias("rating_year"))


@query("cln3_valid_prices", "SELECT c_custkey, c_acctbal >= 0 AS valid FROM customer")
def _(spark, d):
    return roles.table(spark, d, "customer").select("c_custkey", C.valid_number(F.col("c_acctbal")).alias("valid"))


@query("cln7_valid_ratings", f"{R} SELECT rating, count(*) AS n, rating IN (0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5) AS valid FROM ratings_raw GROUP BY 1")
def _(spark, d):
    return roles.ratings_raw(spark, d).groupBy("rating").agg(F.count(F.lit(1)).alias("n")).withColumn("valid", C.valid_rating(F.col("rating")))


@query("arr16_term_counts", "SELECT term, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS term FROM part) GROUP BY 1")
def _(spark, d):
    return roles.table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("fe1_genre_flags", """WITH g AS (SELECT p_partkey, unnest(list_distinct(list_concat([p_type], string_split(p_name, ' ')))) AS genre FROM part),
vocabulary AS (SELECT genre FROM g GROUP BY 1 ORDER BY count(*) DESC, genre LIMIT 15) SELECT p_partkey AS movieId, genre AS feature, CAST(0.25 AS DOUBLE) AS value FROM g WHERE genre IN (FROM vocabulary)""")
def _(spark, d):
    each = roles.movies(spark, d).select(F.col("id").alias("movieId"), F.explode("genres").alias("feature"))
    vocabulary = each.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "feature").limit(15)
    return each.join(F.broadcast(vocabulary.select("feature")), "feature").select("movieId", "feature", F.lit(0.25).alias("value"))


@query("fe5_scaled_numbers", "SELECT p_partkey AS movieId, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () * 0.15, 6) AS budget, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () * 0.15, 6) AS runtime FROM part")
def _(spark, d):
    films = roles.movies(spark, d)
    at = films.agg(*[f(c).alias(f"{c}_{n}") for c in ("budget", "runtime") for n, f in (("avg", F.avg), ("std", F.stddev_pop))])
    scaled = lambda c: F.round((F.col(c) - F.col(f"{c}_avg")) / F.coalesce(F.nullif(f"{c}_std", F.lit(0.0)), F.lit(1.0)) * 0.15, 6)
    return films.join(F.broadcast(at), F.lit(True)).select(F.col("id").alias("movieId"), scaled("budget").alias("budget"), scaled("runtime").alias("runtime"))


NUMERIC, NAMED = ["l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]
NB = """WITH rows_ AS (SELECT *, ceil(l_quantity / 5) / 2 AS rating FROM lineitem),
num AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price, rating, feature, value FROM (SELECT *, l_extendedprice AS price FROM rows_) UNPIVOT (value FOR feature IN (l_extendedprice, l_discount, l_tax))),
eps AS (SELECT max(v) * 1e-9 AS eps FROM (SELECT var_pop(value) AS v FROM num GROUP BY feature)),
g AS (SELECT rating AS label, feature, avg(value) AS mean, var_pop(value) + any_value(eps) AS var FROM num, eps GROUP BY 1, 2),
cat AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS price, rating, feature, value FROM rows_ UNPIVOT (value FOR feature IN (l_returnflag, l_linestatus))),
grid AS (SELECT * FROM (SELECT rating AS label, feature, count(*) AS total FROM cat GROUP BY 1, 2) JOIN (SELECT feature, value, count(*) OVER (PARTITION BY feature) AS kinds FROM (SELECT DISTINCT feature, value FROM cat)) USING (feature)),
c AS (SELECT label, feature, value, (coalesce(n, 0) + 1) / (total + kinds) AS p FROM grid LEFT JOIN (SELECT rating AS label, feature, value, count(*) AS n FROM cat GROUP BY 1, 2, 3) USING (label, feature, value))"""
def rated_lines(spark, d):
    return roles.table(spark, d, "lineitem").withColumn("rating", F.ceil(F.col("l_quantity") / 5).cast("double") / 2)


@query("mdl5_gaussian_parameters", f"{NB} SELECT label, feature, round(mean, 6) AS mean, round(ln(var), 8) AS log_var FROM g")
def _(spark, d):
    return bayes.gaussian(rated_lines(spark, d), "rating", NUMERIC).select("label", "feature", F.round("mean", 6).alias("mean"), F.round(F.ln("var"), 8).alias("log_var"))


@query("mdl6_categorical_parameters", f"{NB} SELECT label, feature, value, round(p, 9) AS p FROM c")
def _(spark, d):
    return rounded(bayes.categorical(rated_lines(spark, d), "rating", NAMED), "p", to=9)


def _load() -> None:
    """The other modules note their queries when they are imported; they may use what is above."""
    from . import cleaning_queries, content_queries, learning_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
