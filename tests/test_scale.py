"""What must not grow: rows stay where they are, alike rows are counted first, files and partitions are bounded."""

import math

import pytest
from pyspark.sql import functions as F

from tesserix.operators import bayes, relational
from tesserix.plans import catalog

SMALL = "/root/testdata/sf0.001"


def shuffled_rows(spark, run) -> int:
    """Rows that a run's stages wrote for others to read."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("made", [lambda df: relational.row_split(df, "k"), lambda df: relational.folds(df, "k")])
def test_ranked_rows_stay(spark, made):
    """Only buckets that a boundary runs through are ranked."""
    rows = spark.range(0, 3000, 1, 3).select(F.col("id").alias("k"), F.spark_partition_id().alias("home")).localCheckpoint()
    there = made(rows).select("*", F.spark_partition_id().alias("there")).collect()
    assert sum(r.home == r.there for r in there) > 2900


def test_split_by_definition(spark):
    """Also where keys repeat and fewer rows than folds are there."""
    import hashlib

    md5 = lambda k: hashlib.md5(f"{k}:42".encode()).hexdigest()
    for n, k in ((1000, 5), (7, 3), (3, 5)):
        order = sorted(range(n), key=md5)
        df = spark.createDataFrame([(i,) for i in range(n)], "k long")
        assert {r.k for r in relational.row_split(df, "k").where("test").collect()} == set(order[: math.ceil(n / 5)])
        sizes = [n // k + (f < n % k) for f in range(k)]
        want = {key: f for f in range(k) for key in order[sum(sizes[:f]) : sum(sizes[: f + 1])]}
        assert {r.k: r.fold for r in relational.folds(df, "k", k=k).collect()} == want
    alike = spark.createDataFrame([(1,)] * 11, "k long")
    assert relational.row_split(alike, "k").where("test").count() == 3
    assert sorted(r["count"] for r in relational.folds(alike, "k").groupBy("fold").count().collect()) == [2, 2, 2, 2, 3]


def test_scores_by_definition(spark):
    """Labels of odd rows; scores are made in batches, not by lambdas row by row."""
    nan, inf = float("nan"), float("inf")
    train = spark.createDataFrame([(1.0, 0.0, "a"), (1.0, 1.0, None), (2.0, 3.0, "b"), (2.0, 5.0, "a"), (3.0, 3.0, "b"), (3.0, 5.0, "a")], "y double, x double, s string")
    model = bayes.fitted(train, "y", ["x"], ["s"])
    got = bayes.predict(spark.createDataFrame([(0, 0.2, "a"), (1, 4.0, "b"), (2, None, "b"), (3, nan, "b"), (4, inf, "b"), (5, 4.0, "never"), (6, 0.5, None)], "i int, x double, s string"), model, ["x"], ["s"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "lambdafunction" not in plan
    # labels 2 and 3 are alike: the smaller one; no number at all: the smallest of all
    assert {r.i: r.predicted for r in got.collect()} == {0: 1.0, 1: 2.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 2.0, 6: 1.0}


def test_scores_equal_to_nine_decimals(spark):
    """Such scores are equal even if they are not the same number."""
    at = "named_struct('mean', 0.0D, 'var', 1.0D)"
    model = spark.sql(f"SELECT array(named_struct('label', 2, 'prior', -0.5D + 1e-12D, 'unseen', 0.0D, 'gauss', map('x', {at}), 'named', map('s', 0.0D)), named_struct('label', 1, 'prior', -0.5D, 'unseen', 0.0D, 'gauss', map('x', {at}), 'named', map('s', 0.0D))) AS classes")
    assert bayes.predict(spark.createDataFrame([(0.0,)], "x double"), model, ["x"], []).first()["predicted"] == 1
    other = model.select(F.transform("classes", lambda k: F.when(k["label"] == 2, k.withField("prior", F.lit(-0.49))).otherwise(k)).alias("classes"))
    assert bayes.predict(spark.createDataFrame([(0.0,)], "x double"), other, ["x"], []).first()["predicted"] == 2


def test_errors_of_alike_rows(spark, unbroadcast):
    df = spark.range(4000).select((F.col("id") % 5).cast("double").alias("rating"), (F.col("id") % 4).cast("double").alias("predicted"), (F.col("id") % 2 == 0).alias("test")).localCheckpoint()
    assert shuffled_rows(spark, lambda: bayes.errors(df, "rating", by=["test"]).collect()) < 1000
    one = bayes.errors(df, "rating").first()
    d = [(i % 5) - (i % 4) for i in range(4000)]
    assert math.isclose(one["mse"], sum(x * x for x in d) / 4000) and math.isclose(one["r2"], 1 - sum(x * x for x in d) / (2 * 4000)) and one["tp"] == 0 and one["tn"] == 3200


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["imp1_bayes_importance", "imp4_group_importance", "imp5_class_parameters"])
def test_split_is_made_once(spark, name):
    """Each parameter reads the training rows; these are split and written first."""
    assert "lineitem.parquet" not in plan(catalog.queries()[name](spark, SMALL))


def test_ratings_are_made_once(spark):
    """Several steps read them, so these read what was written."""
    from tesserix.plans.catalog import Split
    from tesserix.plans.content_queries import Content

    split, both = Split(spark, SMALL), Content(spark, SMALL)
    assert not any("lineitem.parquet" in plan(df) for df in (split.train, split.test, both.split, both.films))


def test_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    """One task reads a file whole, so none holds all rows; and all rows come back, line breaks too."""
    from tesserix.sources import files

    monkeypatch.setattr(files, "FILE_ROWS", 10)
    rows = spark.range(0, 95, 1, 1).selectExpr("cast(id AS string) AS id", "concat('a\\n\"', id, '\", b') AS text")
    path = files.write_csv(rows, str(tmp_path / "x.csv"))
    assert len(list((tmp_path / "x.csv").glob("part-*.csv"))) == 10
    assert sorted(files.read_csv(spark, path).collect()) == sorted(rows.collect())


@pytest.mark.parametrize("name", ["credits", "keywords", "movies_metadata"])
def test_texts_are_parsed_by_all_cores(spark, name):
    """The table is a single small file."""
    from tesserix.sources import raw_roles

    raw = raw_roles.all_raw(spark, SMALL)[name]
    assert raw.groupBy(F.spark_partition_id()).count().count() > 1


def test_terms_stay_with_their_texts(spark):
    """Texts are exchanged, not the terms of each; those of one id count together."""
    from tesserix.operators import content

    rows = [(i // 2 if i < 4 else i, " ".join(f"w{(i * 7 + j * j) % 101}" for j in range(60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, text string").localCheckpoint()
    made = content.tfidf(docs, F.col("text"), stop=[])
    assert shuffled_rows(spark, lambda: made.write.format("noop").mode("overwrite").save()) < 8000
    tf = {(r.id, r.term): r.tf for r in content.term_counts(docs, F.col("text"), ["w0"]).collect()}
    both = (rows[0][1] + " " + rows[1][1]).split()
    assert {t: n for (i, t), n in tf.items() if i == 0} == {t: both.count(t) for t in set(both) - {"w0"}}
    assert {r.id: r.n for r in made.groupBy("id").agg(F.round(F.sum(F.col("value") * F.col("value")), 9).alias("n")).collect()} == {i: 1.0 for i, _ in rows}


def test_trees_grow_on_bounded_partitions(spark, monkeypatch):
    """A file of few bytes may hold many rows, and Spark keeps each with what the trees need."""
    from tesserix.operators import forest

    monkeypatch.setattr(forest, "PART", 100, raising=False)
    seen, made = [], forest.pipeline

    class Spy:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, rows):
            seen.append((rows.count(), max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())))
            return self.inner.fit(rows)

    monkeypatch.setattr(forest, "pipeline", lambda *a, **how: Spy(made(*a, **how)))
    train = spark.range(0, 1000, 1, 1).select((F.col("id") % 3).cast("double").alias("y"), (F.col("id") % 3 + F.col("id") % 2).cast("double").alias("x"), F.when(F.col("id") % 3 == 1, "a").otherwise("b").alias("s"))
    model = forest.fit(train, "y", ["x"], ["s"], trees=3, depth=4)
    assert [n for n, _ in seen] == [1000] and seen[0][1] <= 110
    assert forest.predict(train, model, "y").where("predicted = y").count() > 900
