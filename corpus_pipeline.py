"""The corpus pipeline: five stages from raw documents to packed windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's result and reads it again for the next; the tables
are deleted when the driver ends.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.llm import linededup, minhash, mixing, packing, toxicity
from tesserix.llm.common import WORD, forget_later, fresh, shared_dir, table, word_count

#: Hundredths of similarity from which the pipeline takes documents for near copies. op6 has its own threshold.
NEAR = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labelled rows of docs that aren't held out."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic")
    return toxicity.score(docs, toxicity.fit(docs, labels)).where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines, of any length, that many sources have; n_chars follows."""
    out = linededup.dedup_lines(docs).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, numer: int = 85) -> DataFrame:
    """One document of each group of near copies, similar by numer hundredths or more: the one with the smallest id.

    Documents without an id come after all others, in the order of a hash of their texts; of those
    with one text, one stays. Rows that share an id are one document's and stay or go together.
    """
    key, own = fresh(docs, "key", "gone")
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 60) + F.pmod(F.xxhash64("text"), F.lit(1 << 60))))
    groups = minhash.components_of(rows.select(F.col(key).alias("doc_id"), "text"), numer, 100)
    gone = groups.where("not kept").select(F.col("doc_id").alias(own)).distinct()
    left = lambda some: rows.where(some).join(gone, F.col(key) == F.col(own), "left_anti")
    unnamed, words = F.col("doc_id").isNull(), F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return left(~unnamed).unionByName(left(unnamed & words).dropDuplicates([key])).unionByName(left(unnamed & ~words)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    size, each = fresh(docs, "words", "each")
    rows = docs.withColumn(size, word_count(F.col("text")))
    mixed = mixing.mix(rows, F.col(size), F.col("source"), ["doc_id"])
    return mixed.where("copies > 0").withColumn(each, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, keep_ids=False).drop("ids")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_boilerplate), ("MinHash near-dedup", partial(drop_near_copies, numer=NEAR)), ("mixing", mix_sources), ("packing", pack)]

#: Training, minima and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    forget_later(spark, folder)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
