"""The hybrid naive Bayes rating model: Gaussian and categorical features, the prior counted in both.

Parameters are aggregates; for scoring they become one row of arrays, whose size is checked, and
every row is scored where it stands, by NumPy in Arrow batches: no exchange, and rows that repeat
stay apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tesserix.sources.files import kept

from .relational import folds, row_split, shuffled

SMOOTHING, ALPHA = 1e-9, 1.0
#: The most parameters that are broadcast for scoring.
MOST = 1_000_000
#: The most scores, of rows times classes, that are in memory at once.
SCORES = 1_000_000


def long_form(df: DataFrame, keep: list[str], features: list[str], kind: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast(kind).alias("value")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.value")


def gaussian(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(label, feature, mean, var): population variance plus a share of the largest over all rows."""
    value = {f: F.col(f).cast("double") for f in features}
    top = df.agg((F.array_max(F.array(*[F.var_pop(x) for x in value.values()])) * SMOOTHING).alias("eps"))
    at = [F.struct(F.lit(f).alias("feature"), F.avg(x).alias("mean"), F.var_pop(x).alias("var")) for f, x in value.items()]
    by = df.groupBy(F.col(label).alias("label")).agg(F.array(*at).alias("p")).select("label", F.explode("p").alias("p")).select("label", "p.*")
    return by.join(F.broadcast(top), F.lit(True)).select("label", "feature", "mean", (F.col("var") + F.col("eps")).alias("var"))


def categorical(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(label, feature, value, p) over the full grid of labels and values, smoothed."""
    rows = long_form(df, [label], features, "string")
    n = rows.groupBy(label, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = n.groupBy(label, "feature").agg(F.sum("n").alias("total"))
    values = n.select("feature", "value").distinct().withColumn("kinds", F.count(F.lit(1)).over(W.partitionBy("feature")))
    grid = totals.join(values, "feature").join(n, [label, "feature", "value"], "left")
    p = (F.coalesce("n", F.lit(0)) + ALPHA) / (F.col("total") + ALPHA * F.col("kinds"))
    return grid.select(F.col(label).alias("label"), "feature", "value", p.alias("p"))


def priors(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("label", F.ln(F.col("n") / F.sum("n").over(W.partitionBy())).alias("prior"))


def fitted(df: DataFrame, label: str, numeric: list[str], named: list[str]) -> DataFrame:
    """One row: classes, an array of (label, prior, gauss: feature to its mean and variance, named: feature and value to the logarithm of its share, unseen: the same for a value that the fit has not seen)."""
    g = gaussian(df, label, numeric).groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "var").alias("at")))).alias("gauss"))
    entry = F.struct(F.concat_ws("\0", "feature", "value").alias("k"), F.ln("p").alias("v"))
    c = categorical(df, label, named).groupBy("label").agg(F.map_from_entries(F.collect_list(entry)).alias("named"), F.ln(F.min("p")).alias("unseen"))
    classes = priors(df, label).join(g, "label").join(c, "label")
    return classes.agg(F.collect_list(F.struct("label", "prior", "unseen", "gauss", "named")).alias("classes"))


def labeller(classes: list[Row], numeric: list[str], named: list[str], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """From a batch of structs, numeric features first, to the labels of the largest scores."""
    # a class without a mean or a variance has no score and comes last
    sound = lambda k: all((at := k["gauss"].get(f)) and at["mean"] is not None and at["var"] is not None and not at["var"] <= 0 for f in numeric)
    classes = sorted(classes, key=lambda k: (k["label"] == k["label"], k["label"]))
    scored = [k for k in classes if sound(k)]
    labels = pa.array([k["label"] for k in [*classes[:1], *scored]], kind)
    prior = np.array([2 * k["prior"] for k in scored])
    gauss = [(np.array([k["gauss"][f]["mean"] for k in scored]), np.array([0.5 * math.log(2 * math.pi * k["gauss"][f]["var"]) for k in scored]), np.array([2 * k["gauss"][f]["var"] for k in scored])) for f in numeric]
    places: list[dict[str | None, int]] = [{} for _ in named]
    for k in scored:
        for key in k["named"]:
            f, sep, value = key.partition("\0")
            if f in named:
                at = places[named.index(f)]
                at.setdefault(value if sep else None, len(at))
    shares = [np.array([[k["named"].get(f if v is None else f"{f}\0{v}", k["unseen"]) for k in scored] for v in at] + [[k["unseen"] for k in scored]]) for f, at in zip(named, places, strict=True)]
    step = max(1, SCORES // max(1, len(scored)))

    def best(numbers: list[np.ndarray], codes: list[np.ndarray]) -> np.ndarray:
        score = np.broadcast_to(prior, (len(numbers[0] if numbers else codes[0]), len(prior)))
        for x, (mean, log, var) in zip(numbers, gauss, strict=True):
            z = x[:, None] - mean
            score = score - log - z * z / var
        for at, share in zip(codes, shares, strict=True):
            score = score + share[at]
        # as in Spark's order, what isn't a number is above all numbers
        odd = np.isnan(score)
        high = np.where(odd, np.inf, score)
        top = high.max(axis=1)
        near = np.where(odd.any(axis=1)[:, None], odd, high >= (top - 2e-9)[:, None])
        out = near.argmax(axis=1)
        # scores that nine decimals may make equal
        for r in np.flatnonzero((near.sum(axis=1) > 1) & np.isfinite(top) & (np.where(near, high, np.inf).min(axis=1) < top)):
            said = {c: Decimal(repr(float(score[r, c]))).quantize(Decimal("1e-9"), ROUND_HALF_UP) for c in np.flatnonzero(near[r])}
            out[r] = max(said, key=said.get)
        return out

    def run(rows: pa.Array) -> pa.Array:
        if not len(labels):
            return pa.nulls(len(rows), kind)
        # the place of the label; 0, the smallest, where there are no scores
        columns, out = rows.flatten(), np.zeros(len(rows), "int64")
        if scored and columns:
            numbers = [c.to_numpy(zero_copy_only=False).astype("float64") for c in columns[: len(numeric)]]
            codes = []
            for c, at in zip(columns[len(numeric) :], places, strict=True):
                c = c.dictionary_encode()
                to = np.array([at.get(v, len(at)) for v in [*c.dictionary.to_pylist(), None]], "int64")
                codes.append(to[c.indices.fill_null(len(to) - 1).to_numpy(zero_copy_only=False)])
            with np.errstate(all="ignore"):
                for i in range(0, len(rows), step):
                    out[i : i + step] = 1 + best([x[i : i + step] for x in numbers], [x[i : i + step] for x in codes])
            for c in columns[: len(numeric)]:
                out[c.is_null().to_numpy(zero_copy_only=False)] = 0
        return labels.take(pa.array(out))

    return run


def predict(df: DataFrame, model: DataFrame, numeric: list[str], named: list[str], name: str = "predicted") -> DataFrame:
    """df with the label of the largest sum of both log posteriors to nine decimals, the smallest of equals. A value that the fit has not seen counts like the rarest one."""
    size = model.select(F.aggregate("classes", F.lit(0), lambda a, k: a + F.size(k["gauss"]) + F.size(k["named"])).alias("n")).first()["n"]
    if size and size > MOST:
        raise ValueError(f"{size} parameters are too many to broadcast")
    kind = model.schema["classes"].dataType.elementType["label"].dataType
    best = F.arrow_udf(labeller(model.first()["classes"], numeric, named, to_arrow_type(kind)), kind)
    return df.withColumn(name, best(F.struct(*[F.col(f).cast("double") for f in numeric], *[F.col(f).cast("string") for f in named])))


def trained(df: DataFrame, key: list[str], label: str, numeric: list[str], named: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the model of the training part, all rows with test and predicted)."""
    rows = kept(row_split(df, *key))
    model = kept(fitted(rows.where("NOT test"), label, numeric, named))
    return model, predict(rows, model, numeric, named)


def cross_validated(df: DataFrame, key: list[str], label: str, numeric: list[str], named: list[str], k: int = 5) -> DataFrame:
    """(fold, mse): each fold scored by the model of the others."""
    rows, out = kept(folds(df, *key, k=k)), None
    for fold in range(k):
        model = kept(fitted(rows.where(F.col("fold") != fold), label, numeric, named))
        d = F.col(label) - F.col("predicted")
        one = predict(rows.where(F.col("fold") == fold), model, numeric, named).groupBy("fold").agg(F.avg(d * d).alias("mse"))
        out = one if out is None else out.unionByName(one)
    return out


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """(label, code) of the distinct labels in order, from 0; labels are few, and only they are ordered."""
    return df.select(F.col(label).alias("label")).distinct().withColumn("code", F.dense_rank().over(W.orderBy("label")) - 1)


def level(rating: Column) -> Column:
    return F.when(rating < 2.5, "low").when(rating < 4, "medium").otherwise("high")


def errors(df: DataFrame, actual: str = "actual", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """One row (or one for each of by) of error measures, binary counts and ratios, class accuracy, and of the top fifth by both."""
    by, a, p, n = by or [], F.col("__a"), F.col("__p"), F.col("__n")
    # rows that are alike are counted first, so that few are left where both take few values
    cells = df.groupBy(*by, F.col(actual).alias("__a"), F.col(predicted).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    mean = lambda x: F.try_divide(F.sum(x * n), F.sum(F.when(x.isNotNull(), n)))
    count = lambda x: F.coalesce(F.sum(F.when(x, n)), F.lit(0))
    tops = cells.groupBy(by).agg(F.percentile(a, F.lit(0.8), n).alias("__ta"), F.percentile(p, F.lit(0.8), n).alias("__tp"), mean(a).alias("__mean"))
    cells = cells.join(tops, by) if by else cells.join(F.broadcast(tops), F.lit(True))
    share = lambda x: mean(x.cast("double"))
    good, said = a >= 3.5, p >= 3.5
    top, picked = a >= F.col("__ta"), p >= F.col("__tp")
    out = cells.groupBy(by).agg(
        mean((a - p) * (a - p)).alias("mse"), mean(F.abs(a - p)).alias("mae"), (1 - F.try_divide(F.sum((a - p) * (a - p) * n), F.sum((a - F.col("__mean")) * (a - F.col("__mean")) * n))).alias("r2"), share(F.abs(a - p) <= 0.5).alias("within_half"), share(F.abs(a - p) <= 1).alias("within_one"),
        count(good & said).alias("tp"), count(~good & ~said).alias("tn"), count(~good & said).alias("fp"), count(good & ~said).alias("fn"), share(good == said).alias("binary_accuracy"), share(level(a) == level(p)).alias("class_accuracy"),
        F.coalesce(F.try_divide(count(top & picked), count(picked)), F.lit(0.0)).alias("precision_top20"), F.coalesce(F.try_divide(count(top & picked), count(top)), F.lit(0.0)).alias("recall_top20"),
    )
    div = lambda x, y: F.expr(f"coalesce(try_divide({x}, {y}), 0.0D)")
    return out.withColumns({"binary_precision": div("tp", "tp + fp"), "binary_recall": div("tp", "tp + fn")})


GROUPS = ["Genres", "Keywords", "Actors", "Directors", "User Features", "Temporal Features", "Movie Metadata"]


def group_of(feature: Column) -> Column:
    return (
        F.when(feature.startswith("genre_") | feature.contains("primary_genre"), "Genres").when(feature.startswith("keyword_"), "Keywords").when(feature.startswith("actor_") | feature.contains("cast_size"), "Actors")
        .when(feature.startswith("director_"), "Directors").when(feature.startswith("user_"), "User Features").when(feature.startswith("rating_") & ~feature.contains("count"), "Temporal Features").otherwise("Movie Metadata")
    )


def importance(gauss: DataFrame, named: DataFrame) -> DataFrame:
    """(feature, model_type, importance): spread of the class means over the mean class variance, or of the values' shares over the classes; each family adds up to one."""
    g = gauss.groupBy("feature").agg((F.var_pop("mean") / F.when(F.avg("var") > 1e-10, F.avg("var")).otherwise(1.0)).alias("raw")).withColumn("model_type", F.lit("Gaussian_NB"))
    c = named.groupBy("feature", "value").agg(F.var_pop("p").alias("v")).groupBy("feature").agg(F.sum("v").alias("raw")).withColumn("model_type", F.lit("Categorical_NB"))
    family = W.partitionBy("model_type")  # a row a feature
    total, n = F.sum("raw").over(family), F.count(F.lit(1)).over(family)
    return g.unionByName(c).select("feature", "model_type", F.when(total > 0, F.col("raw") / total).otherwise(1 / n).alias("importance"))


def grouped_importance(table: DataFrame, value: str = "importance") -> DataFrame:
    """(feature_group, total_importance, feature_count, top_features): the first three names by importance, ties by name."""
    found = F.sort_array(F.collect_list(F.struct((-F.round(value, 9)).alias("x"), "feature")))
    by = table.withColumn("feature_group", group_of(F.col("feature"))).groupBy("feature_group")
    return by.agg(F.sum(value).alias("total_importance"), F.count(F.lit(1)).alias("feature_count"), F.array_join(F.transform(F.slice(found, 1, 3), lambda x: x["feature"]), ", ").alias("top_features"))


def permutation_importance(sample: DataFrame, model: DataFrame, key: list[str], label: str, numeric: list[str], named: list[str], repeats: int = 5) -> DataFrame:
    """(feature, importance, percent): how much the squared error grows when a feature's values change places, averaged over repeats, never below 0. sample is small: a head sample, whose rows are ranked in one place."""
    every = [*numeric, *named]
    rows = sample.withColumn("__i", F.row_number().over(W.orderBy(*key)))
    each = rows.withColumn("__f", F.explode(F.array(*map(F.lit, every)))).withColumn("__r", F.explode(F.array(*map(F.lit, range(repeats)))))
    other = each.select("__f", "__r", F.coalesce(*[F.when(F.col("__f") == f, F.col(f).cast("string")) for f in every]).alias("__v"), F.row_number().over(W.partitionBy("__f", "__r").orderBy(shuffled(*key, "__f", "__r"), *key)).alias("__i"))
    mixed = each.join(other, ["__f", "__r", "__i"]).withColumns({f: F.when(F.col("__f") == f, F.col("__v").cast("double" if f in numeric else "string")).otherwise(F.col(f)) for f in every})
    d = F.col(label) - F.col("predicted")
    base = predict(rows, model, numeric, named).agg(F.avg(d * d).alias("base"))
    moved = predict(mixed, model, numeric, named).groupBy("__f", "__r").agg(F.avg(d * d).alias("mse"))
    drop = moved.join(F.broadcast(base), F.lit(True)).groupBy(F.col("__f").alias("feature")).agg(F.greatest(F.avg(F.col("mse") - F.col("base")), F.lit(0.0)).alias("importance"))
    total = F.sum("importance").over(W.partitionBy())
    return drop.withColumn("percent", F.when(total > 0, 100 * F.col("importance") / total).otherwise(0.0))


def class_analysis(gauss: DataFrame, features: list[str]) -> DataFrame:
    """(feature, label, mean, var) of at most ten features."""
    return gauss.where(F.col("feature").isin(features[:10])).select("feature", "label", "mean", "var")


def worked_example(gauss: DataFrame, feature: str) -> DataFrame:
    """How one feature's importance comes about: its class means, their mean, squared deviations and spread."""
    one = gauss.where(F.col("feature") == feature)
    at = one.agg(F.avg("mean").alias("overall_mean"), F.var_pop("mean").alias("between"), F.avg("var").alias("within"))
    return one.join(F.broadcast(at), F.lit(True)).select("feature", "label", "mean", "overall_mean", ((F.col("mean") - F.col("overall_mean")) ** 2).alias("squared_deviation"), "between", "within")
