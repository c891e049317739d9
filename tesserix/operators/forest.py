"""The random forest rating model on Spark's own forests."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import stratified_folds

TREES, DEPTH, LEAF, SEED = 100, 20, 2, 42
#: Rows of a partition while the trees grow; Spark keeps some 250 bytes of each there for ten trees.
PART = 250_000


def pipeline(label: str, numeric: list[str], named: list[str], trees: int = TREES, depth: int = DEPTH, bins: int = 32) -> Pipeline:
    """Codes of the named features, the trees, and the ratings back from their codes. Features have no nulls."""
    codes = StringIndexer(inputCols=named, outputCols=[f"{c}_code" for c in named], stringOrderType="alphabetAsc", handleInvalid="keep")
    target = StringIndexer(inputCol="__label", outputCol="__y", stringOrderType="alphabetAsc")
    vector = VectorAssembler(inputCols=[*numeric, *[f"{c}_code" for c in named]], outputCol="__x")
    forest = RandomForestClassifier(labelCol="__y", featuresCol="__x", predictionCol="__p", probabilityCol="__prob", rawPredictionCol="__raw", numTrees=trees, maxDepth=depth, minInstancesPerNode=LEAF, featureSubsetStrategy="sqrt", seed=SEED, maxBins=bins, maxMemoryInMB=512)
    return Pipeline(stages=[codes, target, vector, forest])


def fit(train: DataFrame, label: str, numeric: list[str], named: list[str], **how) -> PipelineModel:
    """The rows are dealt out evenly and kept until the trees are grown: files of few bytes may hold many rows."""
    rows = train.select(F.col(label).cast("string").alias("__label"), *numeric, *named)
    rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipeline(label, numeric, named, **how).fit(rows)
    finally:
        rows.unpersist()


def predict(df: DataFrame, model: PipelineModel, label: str) -> DataFrame:
    """df with predicted, a rating."""
    labels = model.stages[1].labels
    out = model.transform(df.withColumn("__label", F.col(label).cast("string")))
    out = IndexToString(inputCol="__p", outputCol="__said", labels=labels).transform(out)
    return out.select(*df.columns, F.col("__said").cast("double").alias("predicted"))


def importance(df: DataFrame, model: PipelineModel) -> DataFrame:
    """(feature, importance): the mean decrease of impurity."""
    names, values = model.stages[2].getInputCols(), model.stages[3].featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(names, values, strict=True)), "feature string, importance double")


def cross_validated(df: DataFrame, key: list[str], label: str, numeric: list[str], named: list[str], k: int = 5, **how) -> DataFrame:
    """(fold, accuracy) over folds that hold every label evenly."""
    rows, out = stratified_folds(df, label, *key, k=k), None
    for fold in range(k):
        model = fit(rows.where(F.col("fold") != fold), label, numeric, named, **how)
        one = predict(rows.where(F.col("fold") == fold), model, label).groupBy("fold").agg(F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out
