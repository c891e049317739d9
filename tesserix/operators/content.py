"""The content-based recommender: weighted sparse features of movies, profiles of users, cosine scores.

Features are rows (id, feature, value). Vocabularies are found by counts and joined, never carried
to the driver. Scores are made block by block: blocks of movies meet blocks of profiles in Arrow
groups, each gives its best for every user, and these are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import LIKED

WEIGHTS = {"genre": 0.25, "keyword": 0.20, "cast": 0.15, "director": 0.10, "company": 0.0, "studio": 0.0, "language": 0.02, "text": 0.15, "number": 0.15}
TOPS = {"genre": None, "keyword": 25, "cast": 20, "director": 10}
FIRST_YEAR, NEUTRAL, LEAST, TOP_N = 2000, 3.0, 0.01, 15
TERMS, MIN_DF, MAX_DF = 50, 5, 0.8
#: Movies and users of a block.
MOVIES, USERS = 4096, 2048


def merged(movies: DataFrame, credits: DataFrame, keywords: DataFrame, since: int = FIRST_YEAR) -> DataFrame:
    """Movies of a year on, with their credits and keywords, empty where there are none. Repeated ids fan out."""
    none = F.array().cast("array<string>")
    both = movies.where(F.coalesce(F.col("release_year"), F.lit(0)) >= since).join(credits, "id", "left").join(keywords, "id", "left")
    return both.withColumns({c: F.coalesce(c, none) for c in ("lead_actors", "directors", "keywords")})


def rated_only(films: DataFrame, ratings: DataFrame) -> DataFrame:
    """Films with a positive id that somebody rated."""
    return films.where(F.coalesce("id", F.lit(-1)) > 0).join(ratings.select(F.col("movieId").alias("id")), "id", "left_semi")


def vocabulary(each: DataFrame, top: int | None = None, least: int = 1) -> DataFrame:
    """(feature) of the commonest features of rows (id, feature), ties by name; those of too few rows are left out first."""
    counts = each.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return (counts if top is None else counts.orderBy(F.desc("n"), "feature").limit(top)).select("feature")


def flags(films: DataFrame, values: Column, prefix: str, weight: float, top: int | None = None, least: int = 1) -> DataFrame:
    """One row for each known member of a list; members that repeat count once as features, but each time for the vocabulary."""
    each = films.select("id", F.explode(values).alias("feature"))
    known = vocabulary(each, top, least)
    return each.distinct().join(known, "feature").select("id", F.concat(F.lit(prefix), "feature").alias("feature"), F.lit(float(weight)).alias("value"))


def studios(films: DataFrame, weight: float, top: int | None = 20, least: int = 5) -> DataFrame:
    """One studio a movie: 'Unknown' without one, 'Other' for the rare ones."""
    each = films.select("id", F.coalesce("main_studio", F.lit("Unknown")).alias("feature"))
    known = vocabulary(each, top, least).withColumn("known", F.lit(True))
    return each.join(known, "feature", "left").select("id", F.concat(F.lit("studio_"), F.when(F.col("known"), F.col("feature")).otherwise("Other")).alias("feature"), F.lit(float(weight)).alias("value"))


def languages(films: DataFrame, weight: float) -> DataFrame:
    return films.select("id", F.concat(F.lit("language_"), F.coalesce("original_language", F.lit("unknown"))).alias("feature"), F.lit(float(weight)).alias("value"))


def tokens(text: Column) -> Column:
    """Runs of two or more letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def stop_words() -> list[str]:
    return sorted(set(StopWordsRemover.loadDefaultStopWords("english")))


def term_counts(docs: DataFrame, text: Column, stop: list[str]) -> DataFrame:
    """(id, term, tf) of texts, less stop words. Texts are brought together by id before they are taken apart, so that their terms need no exchange."""
    texts = docs.select("id", F.coalesce(text, F.lit("")).alias("text")).repartition("id")
    each = texts.select("id", F.explode(tokens(F.col("text"))).alias("term"))
    return each.where(~F.col("term").isin(stop)).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def terms(tf: DataFrame, n: DataFrame, top: int | None = TERMS, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """(term, df, n): the commonest terms that are neither too rare nor in too many texts. n: one row, the number of texts."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).join(F.broadcast(n), F.lit(True)).where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * F.col("n")))
    return (df if top is None else df.orderBy(F.desc("total"), "term").limit(top)).select("term", "df", "n")


def tfidf(docs: DataFrame, text: Column, weight: float = 1.0, prefix: str = "word_", top: int | None = TERMS, min_df: int = MIN_DF, max_df: float = MAX_DF, stop: list[str] | None = None) -> DataFrame:
    """Smoothed TF-IDF, scaled to length one a text, times a weight. A text without known terms has no rows."""
    tf = term_counts(docs, text, stop_words() if stop is None else stop)
    known = terms(tf, docs.agg(F.count(F.lit(1)).alias("n")), top, min_df, max_df)
    raw = tf.join(known if top is None else F.broadcast(known), "term").withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    return raw.withColumn("length", length).select("id", F.concat(F.lit(prefix), "term").alias("feature"), (F.col("w") / F.col("length") * weight).alias("value"))


def numbers(films: DataFrame, weight: float) -> DataFrame:
    """Five numbers, missing ones filled, scaled by mean and population deviation."""
    sound = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    fills = {"vote_average": F.avg("vote_average"), "popularity": F.lit(0.0), "release_year": F.lit(2000.0), "runtime": F.avg("runtime")}
    means = films.agg(*[F.coalesce(x, F.lit(0.0)).alias(f"__{c}") if "avg" in str(x) else F.first(x).alias(f"__{c}") for c, x in fills.items()])
    rows = films.withColumns({c: F.col(c).cast("double") for c in fills}).join(F.broadcast(means), F.lit(True))
    rows = rows.select("id", *[F.coalesce(F.coalesce(sound(c), F.when(F.col(c).isNull(), F.col(f"__{c}"))), F.lit(0.0)).alias(c) for c in fills], F.coalesce(F.col("adult").cast("double"), F.lit(0.0)).alias("adult"))
    names = [*fills, "adult"]
    at = rows.agg(*[F.avg(c).alias(f"__m_{c}") for c in names], *[F.stddev_pop(c).alias(f"__s_{c}") for c in names])
    scaled = rows.join(F.broadcast(at), F.lit(True)).select("id", *[((F.col(c) - F.col(f"__m_{c}")) / F.coalesce(F.nullif(f"__s_{c}", F.lit(0.0)), F.lit(1.0)) * weight).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(f"number_{c}").alias("feature"), F.col(c).alias("value")) for c in names])
    return scaled.select("id", F.explode(pairs).alias("p")).select("id", "p.feature", "p.value")


def features(films: DataFrame, weights: dict[str, float] | None = None, tops: dict[str, int | None] | None = None, stop: list[str] | None = None) -> DataFrame:
    """(id, feature, value) of all blocks with a weight above 0, values of 0 left out."""
    w, top = WEIGHTS | (weights or {}), TOPS | (tops or {})
    blocks = {
        "genre": lambda: flags(films, F.col("genres"), "genre_", w["genre"], top["genre"]), "keyword": lambda: flags(films, F.col("keywords"), "keyword_", w["keyword"], top["keyword"]),
        "cast": lambda: flags(films, F.slice("lead_actors", 1, 3), "actor_", w["cast"], top["cast"]), "director": lambda: flags(films, F.col("directors"), "director_", w["director"], top["director"]),
        "company": lambda: flags(films, F.slice("production_companies", 1, 2), "company_", w["company"], least=3), "studio": lambda: studios(films, w["studio"]), "language": lambda: languages(films, w["language"]),
        "text": lambda: tfidf(films, F.col("overview"), w["text"], stop=stop), "number": lambda: numbers(films, w["number"]),
    }
    out = None
    for name, block in blocks.items():
        if w[name] > 0:
            out = block() if out is None else out.unionByName(block())
    return out.where("value <> 0")


def profiles(train: DataFrame, feats: DataFrame) -> DataFrame:
    """(userId, feature, value): features of a user's movies, weighted by how far the ratings are from neutral."""
    w = F.col("rating") - NEUTRAL
    known = train.join(feats.select(F.col("id").alias("movieId")).distinct(), "movieId", "left_semi").withColumn("w", w)
    size = known.groupBy("userId").agg(F.sum(F.abs("w")).alias("size"))
    sums = known.join(feats.withColumnRenamed("id", "movieId"), "movieId").groupBy("userId", "feature").agg(F.sum(F.col("w") * F.col("value")).alias("s"))
    return sums.join(size, "userId").select("userId", "feature", F.when(F.col("size") > 0, F.col("s") / F.col("size")).otherwise(F.col("s")).alias("value"))


def best_in_block(top: int, least: float):
    def run(films: pa.Table, people: pa.Table) -> pa.Table:
        none = pa.table({"userId": pa.array([], pa.int64()), "movieId": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        kind = people.column("kind").to_numpy()
        profile, seen = people.filter(pa.array(kind == 0)), people.filter(pa.array(kind == 1))
        if not films.num_rows or not profile.num_rows:
            return none
        ids, row = np.unique(films.column("key").to_numpy(), return_inverse=True)
        users, urow = np.unique(profile.column("userId").to_numpy(), return_inverse=True)
        names, col = np.unique(np.concatenate((films.column("feature").to_numpy(), profile.column("feature").to_numpy())), return_inverse=True)
        m, p = np.zeros((len(ids), len(names))), np.zeros((len(users), len(names)))
        np.add.at(m, (row, col[: len(row)]), films.column("value").to_numpy())
        np.add.at(p, (urow, col[len(row) :]), profile.column("value").to_numpy())
        for x in (m, p):
            length = np.sqrt((x * x).sum(axis=1))
            x /= np.where(length > 0, length, 1)[:, None]
        score = p @ m.T
        if seen.num_rows:
            u, i = seen.column("userId").to_numpy(), seen.column("feature").to_numpy()
            a, b = np.searchsorted(users, u), np.searchsorted(ids, i)
            ok = (a < len(users)) & (b < len(ids))
            a, b, u, i = a[ok], b[ok], u[ok], i[ok]
            ok = (users[a] == u) & (ids[b] == i)
            score[a[ok], b[ok]] = -np.inf
        out = []
        for k, own in enumerate(score):
            at = np.flatnonzero(own > least)
            value = np.round(own[at], 9)
            at = at[np.lexsort((ids[at], -value))[:top]]
            out += [(users[k], ids[j], own[j]) for j in at]
        return pa.table({n: pa.array([r[c] for r in out], t) for c, (n, t) in enumerate((("userId", pa.int64()), ("movieId", pa.int64()), ("score", pa.float64())))})

    return run


def recommend(people: DataFrame, feats: DataFrame, train: DataFrame, top: int = TOP_N, least: float = LEAST) -> DataFrame:
    """(userId, movieId, score, rank): the movies most like a user's profile that the user has not got, above a least cosine."""
    nm, nu = (max(1, -(-df.select(F.countDistinct(c)).first()[0] // size)) for df, c, size in ((feats, "id", MOVIES), (people, "userId", USERS)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    films = feats.select(F.col("id").cast("long").alias("key"), F.xxhash64("feature").alias("feature"), "value", part("id", nm).alias("mb"), every(nu).alias("ub"))
    own = people.select(F.lit(0).alias("kind"), "userId", F.xxhash64("feature").alias("feature"), "value", part("userId", nu).alias("ub"), every(nm).alias("mb"))
    seen = train.select(F.lit(1).alias("kind"), "userId", F.col("movieId").cast("long").alias("feature"), F.lit(0.0).alias("value"), part("userId", nu).alias("ub"), part("movieId", nm).alias("mb"))
    found = films.groupBy("ub", "mb").cogroup(own.unionByName(seen).groupBy("ub", "mb")).applyInArrow(best_in_block(top, least), "userId long, movieId long, score double")
    rank = F.row_number().over(W.partitionBy("userId").orderBy(F.desc(F.round("score", 9)), "movieId"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


METRICS = ["accuracy", "precision", "recall", "hit_rate", "enjoyment_precision", "enjoyment_recall"]


def evaluate(recommended: DataFrame, test: DataFrame, universe: DataFrame, liked: float = LIKED) -> DataFrame:
    """Per user with recommendations and hidden movies: counts and ratios. universe: one row, the number of movies."""
    both = recommended.select("userId", "movieId", F.lit(1).alias("rec")).join(test.select("userId", "movieId", "rating"), ["userId", "movieId"], "full")
    rec, act, joy = F.col("rec").isNotNull(), F.col("rating").isNotNull(), F.coalesce(F.col("rating") >= liked, F.lit(False))
    n = both.groupBy("userId").agg(F.count_if(rec & act).alias("tp"), F.count_if(rec & ~act).alias("fp"), F.count_if(~rec & act).alias("fn"), F.count_if(rec & joy).alias("e_tp"), F.count_if(~rec & joy).alias("e_fn"))
    n = n.where("tp + fp > 0 AND tp + fn > 0").join(F.broadcast(universe), F.lit(True))
    n = n.withColumns({"tn": F.expr("movies - tp - fp - fn"), "e_fp": F.expr("tp + fp - e_tp")}).withColumn("e_tn", F.expr("movies - e_tp - e_fp - e_fn"))
    div = lambda a, b: F.expr(f"coalesce(try_divide({a}, {b}), 0.0D)")
    ratios = {"accuracy": div("tp + tn", "movies"), "precision": div("tp", "tp + fp"), "recall": div("tp", "tp + fn"), "hit_rate": (F.col("tp") > 0).cast("double"), "enjoyment_precision": div("e_tp", "tp + fp"), "enjoyment_recall": div("e_tp", "e_tp + e_fn")}
    return n.withColumns(ratios).drop("movies")
