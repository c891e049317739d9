"""Edge rows of the cleaning functions."""

from pyspark.sql import functions as F

from tesserix.functions import cleaning as C


def column(spark, values, made):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", made(F.col("v")).alias("x")).orderBy("i").collect()]


def test_number(spark):
    assert column(spark, ["abc", "1e3", "-1", "nan", "1.0d", None, " 2 "], C.number) == [None, 1000.0, -1.0, None, None, None, 2.0]
    assert column(spark, ["1", "-1", "inf", None], lambda c: C.valid_number(C.number(c))) == [True, False, False, False]


def test_flags(spark):
    assert column(spark, ["True", "False", "true", None], C.flag) == [True, False, False, False]
    assert column(spark, [" EN ", None], C.language) == ["en", None]
    assert column(spark, ["0.5", "5.0", "0", "3.7", "x"], lambda c: C.valid_rating(C.number(c))) == [True, True, False, False, False]


def test_dates(spark):
    assert column(spark, ["1995-10-30", "bad", None], lambda c: C.date_parts(c)["release_decade"]) == [1990, None, None]


def test_members(spark):
    cast = '[{"name":"b","order":2},{"name":"a"},{"name":"c","order":2},{"name":"d","order":0}]'
    assert column(spark, [None, "", "garbage", "{'name':'A'}", cast], lambda c: C.names(C.members(c))) == [[], [], [], [], ["b", "a", "c", "d"]]
    assert column(spark, [cast], lambda c: C.lead_names(C.members(c))) == [["d", "b", "c", "a"]]
    crew = '[{"name":"x","job":"Executive Producer"},{"job":"Director"},{"name":"y","job":"Original Music Composer"},{"name":"z"}]'
    assert column(spark, [crew], lambda c: C.names_where(C.members(c), lambda x: x["job"].contains("Producer"))) == [["x"]]
    assert column(spark, [crew], lambda c: C.names_where(C.members(c), lambda x: x["job"] == "Director")) == [[""]]
