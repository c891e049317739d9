"""Queries of the content-based recommender."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserix.operators import content, relational
from tesserix.sources import roles
from tesserix.sources.files import kept

from .catalog import ratings
from .registry import query, rounded

STOP = ["the", "of", "and"]
R = f"WITH {roles.VIEWS}, {roles.FILMS}"
#: Ratings of sampled, active users, split; and the films that they rated.
SPLIT = """, chosen AS (SELECT userId FROM (SELECT DISTINCT userId FROM ratings ORDER BY md5(userId || ':42'), userId LIMIT 10000)),
active AS (SELECT * FROM ratings WHERE userId IN (FROM chosen) AND userId IN (SELECT userId FROM ratings GROUP BY 1 HAVING count(*) >= 10)),
split AS (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY rating_year, movieId) <= count(*) OVER (PARTITION BY userId) * 4 // 5 AS train FROM active),
kept_films AS (SELECT * FROM films WHERE coalesce(release_year, 0) >= 2000 AND id > 0 AND id IN (SELECT movieId FROM active))"""


def flag_sql(name: str, source: str, prefix: str, weight: float, top: int | None, films: str = "kept_films") -> str:
    limit = f" ORDER BY count(*) DESC, v LIMIT {top}" if top else ""
    return f", {name} AS (SELECT DISTINCT id, '{prefix}' || v AS feature, CAST({weight} AS DOUBLE) AS value FROM (SELECT id, unnest({source}) AS v FROM {films}) WHERE v IN (SELECT v FROM (SELECT id, unnest({source}) AS v FROM {films}) GROUP BY v{limit}))"


def tfidf_sql(name: str, films: str, text: str, weight: float, prefix: str, top: int, min_df: int, max_df: float) -> str:
    return f""", {name}_t AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS t FROM {films}) WHERE t NOT IN ('the', 'of', 'and') GROUP BY 1, 2),
{name}_d AS (SELECT t, count(*) AS df, (SELECT count(*) FROM {films}) AS n FROM {name}_t GROUP BY t HAVING count(*) >= {min_df} AND count(*) <= CAST({max_df} AS DOUBLE) * (SELECT count(*) FROM {films}) ORDER BY sum(tf) DESC, t LIMIT {top}),
{name}_w AS (SELECT id, t, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM {name}_t JOIN {name}_d USING (t)),
{name} AS (SELECT id, '{prefix}' || t AS feature, w / sqrt(sum(w * w) OVER (PARTITION BY id)) * {weight} AS value FROM {name}_w)"""


NUMBERS = """, filled AS (SELECT id, coalesce(vote_average, (SELECT avg(vote_average) FROM kept_films)) AS vote_average, coalesce(popularity, 0) AS popularity, CAST(coalesce(release_year, 2000) AS DOUBLE) AS release_year,
  coalesce(runtime, (SELECT avg(runtime) FROM kept_films)) AS runtime, CAST(adult AS DOUBLE) AS adult FROM kept_films),
num AS (SELECT id, 'number_' || name AS feature, (x - avg(x) OVER (PARTITION BY name)) / coalesce(nullif(stddev_pop(x) OVER (PARTITION BY name), 0), 1) * 0.15 AS value
  FROM filled UNPIVOT (x FOR name IN (vote_average, popularity, release_year, runtime, adult)))"""
BLOCKS = (
    flag_sql("f1", "genres", "genre_", 0.25, None) + flag_sql("f2", "keywords", "keyword_", 0.2, 25) + flag_sql("f3", "lead_actors[:3]", "actor_", 0.15, 20) + flag_sql("f4", "directors", "director_", 0.1, 10)
    + ", f5 AS (SELECT id, 'language_' || coalesce(original_language, 'unknown') AS feature, CAST(0.02 AS DOUBLE) AS value FROM kept_films)" + tfidf_sql("f6", "kept_films", "overview", 0.15, "word_", 50, 5, 0.8) + NUMBERS
    + ", feat AS (SELECT * FROM (FROM f1 UNION ALL FROM f2 UNION ALL FROM f3 UNION ALL FROM f4 UNION ALL FROM f5 UNION ALL FROM f6 UNION ALL FROM num) WHERE value <> 0)"
)
PROFILES = """, weighted AS (SELECT userId, movieId, rating - 3 AS w FROM split WHERE train AND movieId IN (SELECT id FROM feat)),
sizes AS (SELECT userId, sum(abs(w)) AS size FROM weighted GROUP BY 1),
profiles AS (SELECT userId, feature, CASE WHEN size > 0 THEN s / size ELSE s END AS value FROM (SELECT userId, feature, sum(w * value) AS s FROM weighted JOIN feat ON movieId = id GROUP BY 1, 2) JOIN sizes USING (userId))"""
RECS = """, pl AS (SELECT userId, sqrt(sum(value * value)) AS l FROM profiles GROUP BY 1), ml AS (SELECT id, sqrt(sum(value * value)) AS l FROM feat GROUP BY 1),
scores AS (SELECT userId, id AS movieId, dot / (pl.l * ml.l) AS score FROM (SELECT userId, id, sum(p.value * f.value) AS dot FROM profiles p JOIN feat f USING (feature) GROUP BY 1, 2) JOIN pl USING (userId) JOIN ml USING (id) WHERE pl.l > 0),
recs AS (SELECT * FROM (SELECT userId, movieId, score, row_number() OVER (PARTITION BY userId ORDER BY round(score, 9) DESC, movieId) AS rank FROM scores s
  WHERE score > 0.01 AND NOT EXISTS (SELECT 1 FROM split t WHERE t.train AND t.userId = s.userId AND t.movieId = s.movieId)) WHERE rank <= 15)"""
EVAL = """, pairs AS (SELECT coalesce(r.userId, h.userId) AS userId, r.movieId AS rec, h.movieId AS act, h.rating FROM recs r FULL JOIN (SELECT * FROM split WHERE NOT train) h ON r.userId = h.userId AND r.movieId = h.movieId),
counted AS (SELECT userId, count(*) FILTER (rec IS NOT NULL AND act IS NOT NULL) AS tp, count(*) FILTER (rec IS NOT NULL AND act IS NULL) AS fp, count(*) FILTER (rec IS NULL AND act IS NOT NULL) AS fn,
  count(*) FILTER (rec IS NOT NULL AND rating >= 3.5) AS e_tp, count(*) FILTER (rec IS NULL AND rating >= 3.5) AS e_fn, (SELECT count(DISTINCT id) FROM feat) AS movies FROM pairs GROUP BY 1),
metrics AS (SELECT userId, tp, fp, fn, movies - tp - fp - fn AS tn, e_tp, tp + fp - e_tp AS e_fp, e_fn, movies - tp - fp - e_fn AS e_tn, (movies - fp - fn) / movies AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
  CAST(tp > 0 AS DOUBLE) AS hit_rate, e_tp / (tp + fp) AS enjoyment_precision, coalesce(e_tp / nullif(e_tp + e_fn, 0), 0) AS enjoyment_recall FROM counted WHERE tp + fp > 0 AND tp + fn > 0)"""


class Content:
    """The recommender's tables. Ratings, active users' rows and the feature table are used by several steps, so they are written once."""

    def __init__(self, spark, d):
        users = kept(ratings(spark, d))
        chosen = relational.sampled_users(users).select("userId")
        self.active = kept(relational.at_least(users.join(chosen, "userId", "left_semi"), "userId", 10))
        self.split = relational.time_split(self.active)
        self.train, self.test = self.split.where("train").drop("train"), self.split.where("NOT train").drop("train")
        parts = roles.film_parts(spark, d)
        self.merged = content.merged(parts["movies"], parts["credits"], parts["keywords"])
        self.films = content.rated_only(self.merged, self.active)
        self.features = content.features(self.films, stop=STOP)

    def recommended(self):
        feats = kept(self.features)
        people = kept(content.profiles(self.train, feats))
        return content.recommend(people, feats, self.train), feats


@query("jn2_movie_features", f"{R} SELECT id, title, array_to_string(lead_actors, '|') AS lead_actors, array_to_string(directors, '|') AS directors, array_to_string(keywords, '|') AS keywords FROM films WHERE coalesce(release_year, 0) >= 2000")
def _(spark, d):
    """Films from 2000 on (flt4) with their credits and keywords."""
    lists = [F.array_join(c, "|").alias(c) for c in ("lead_actors", "directors", "keywords")]
    return Content(spark, d).merged.select("id", "title", *lists)


@query("flt7_positive_ids", f"{R} SELECT id FROM films WHERE id > 0")
def _(spark, d):
    return roles.film_parts(spark, d)["movies"].where(F.coalesce("id", F.lit(-1)) > 0).select("id")


@query("flt10_rated_films", f"{R}{SPLIT} SELECT id, title FROM kept_films")
def _(spark, d):
    return Content(spark, d).films.select("id", "title")


@query("win2_time_split", f"{R}{SPLIT} SELECT userId, movieId, train FROM split")
def _(spark, d):
    return Content(spark, d).split.select("userId", "movieId", "train")


@query("win3_random_split", f"{R} SELECT userId, movieId, row_number() OVER (PARTITION BY userId ORDER BY md5(userId || ':' || movieId || ':42'), movieId) <= count(*) OVER (PARTITION BY userId) * 4 // 5 AS train FROM ratings")
def _(spark, d):
    return relational.time_split(ratings(spark, d).drop("rating_year")).select("userId", "movieId", "train")


@query("smp1_sampled_users", f"{R} SELECT DISTINCT userId FROM ratings ORDER BY md5(userId || ':42'), userId LIMIT 10000")
def _(spark, d):
    return relational.sampled_users(ratings(spark, d)).select("userId")


@query("fe1_weighted_flags", f"{R}{SPLIT}{BLOCKS} SELECT * FROM feat WHERE split_part(feature, '_', 1) IN ('genre', 'keyword', 'actor', 'director')")
def _(spark, d):
    return Content(spark, d).features.where("split_part(feature, '_', 1) IN ('genre', 'keyword', 'actor', 'director')")


FE2 = flag_sql("c", "production_companies[:2]", "company_", 0.5, None, "films").replace("GROUP BY v", "GROUP BY v HAVING count(*) >= 3")


@query("fe2_companies_and_studios", f"""{R}{FE2}, st AS (SELECT id, coalesce(main_studio, 'Unknown') AS s FROM films), kn AS (SELECT s FROM st GROUP BY 1 HAVING count(*) >= 5 ORDER BY count(*) DESC, s LIMIT 20)
SELECT * FROM c UNION ALL SELECT id, 'studio_' || CASE WHEN s IN (FROM kn) THEN s ELSE 'Other' END, CAST(0.5 AS DOUBLE) FROM st""")
def _(spark, d):
    films = roles.film_parts(spark, d)["movies"]
    return content.flags(films, F.slice("production_companies", 1, 2), "company_", 0.5, least=3).unionByName(content.studios(films, 0.5))


@query("fe3_languages", f"{R} SELECT id, 'language_' || coalesce(original_language, 'unknown') AS feature, CAST(0.02 AS DOUBLE) AS value FROM films")
def _(spark, d):
    return content.languages(roles.film_parts(spark, d)["movies"], content.WEIGHTS["language"])


@query("fe4_tfidf", "WITH docs AS (SELECT doc_id AS id, text FROM documents)" + tfidf_sql("x", "docs", "text", 0.15, "word_", 50, 5, 0.8) + " SELECT id, feature, round(value, 6) AS value FROM x")
def _(spark, d):
    docs = roles.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return rounded(content.tfidf(docs, F.col("text"), 0.15, stop=STOP), "value")


@query("fe5_number_block", f"{R}{SPLIT}{NUMBERS} SELECT id, feature, round(value, 6) AS value FROM num")
def _(spark, d):
    return rounded(content.numbers(Content(spark, d).films, 0.15), "value")


@query("fe6_all_features", f"{R}{SPLIT}{BLOCKS} SELECT id, feature, round(value, 6) AS value FROM feat")
def _(spark, d):
    return rounded(Content(spark, d).features, "value")


@query("imp7_feature_groups", f"{R}{SPLIT}{BLOCKS} SELECT split_part(feature, '_', 1) AS block, count(DISTINCT feature) AS features FROM feat GROUP BY 1")
def _(spark, d):
    return Content(spark, d).features.groupBy(F.split_part("feature", F.lit("_"), F.lit(1)).alias("block")).agg(F.countDistinct("feature").alias("features"))


@query("agg9_profiles", f"{R}{SPLIT}{BLOCKS}{PROFILES} SELECT userId, feature, round(value, 11) AS value FROM profiles")
def _(spark, d):
    c = Content(spark, d)
    return rounded(content.profiles(c.train, kept(c.features)), "value", to=11)


@query("mdl3_content_recommendations", f"{R}{SPLIT}{BLOCKS}{PROFILES}{RECS} SELECT userId, movieId, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM recs")
def _(spark, d):
    return rounded(Content(spark, d).recommended()[0], "score")


COUNTS = ["tp", "fp", "fn", "tn", "e_tp", "e_fp", "e_fn", "e_tn"]


def metrics(spark, d):
    c = Content(spark, d)
    recs, feats = c.recommended()
    return content.evaluate(recs, c.test, feats.agg(F.countDistinct("id").alias("movies")))


@query("evl3_content_users", f"{R}{SPLIT}{BLOCKS}{PROFILES}{RECS}{EVAL} SELECT userId, {', '.join(COUNTS)}, " + ", ".join(f"round({m}, 6) AS {m}" for m in content.METRICS) + " FROM metrics")
def _(spark, d):
    return rounded(metrics(spark, d), *content.METRICS).select("userId", *COUNTS, *content.METRICS)


@query("evl3_content_averages", f"{R}{SPLIT}{BLOCKS}{PROFILES}{RECS}{EVAL} SELECT count(*) AS evaluated_users, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in [*COUNTS, *content.METRICS]) + " FROM metrics")
def _(spark, d):
    return metrics(spark, d).agg(F.count(F.lit(1)).alias("evaluated_users"), *[F.round(F.avg(m), 6).alias(m) for m in [*COUNTS, *content.METRICS]])
