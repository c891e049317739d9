"""Text sources and sinks: the raw CSV tables, the cleaned ones, feature lists and reports.

Readers are lazy and take every column as text, so that junk in a column costs a value and not
the file. Quoted fields may hold line breaks, for which Spark reads a file as a whole: keep
large tables in many files of one folder, as the writer does.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

#: Texts that count as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: File names of the raw tables.
RAW = {"credits": "credits.csv", "keywords": "keywords.csv", "movies_metadata": "movies_metadata.csv", "ratings": "ratings.csv"}
#: The most rows of a file: each is read by one task.
FILE_ROWS = 200_000
#: Tables that the learners load: four cleaned ones and the links.
RATED = {"movies": "movies_metadata_cleaned.csv", "credits": "credits_cleaned.csv", "keywords": "keywords_cleaned.csv", "ratings": "ratings_cleaned.csv", "links": "links.csv"}
FORMAT = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV table with a header, all columns text, missing marks as null; columns prunes it."""
    raw = spark.read.options(**FORMAT, inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    kept = raw.select([F.col(f"`{c}`") for c in columns]) if columns else raw
    return kept.select([F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in kept.columns])


def optional_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame | None:
    """The table, or None where it can't be found: the callers go on without it."""
    try:
        return read_csv(spark, path, columns)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_csv(spark, f"{folder}/{file}") for name, file in RAW.items()}


def load_rated(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five tables of the learners."""
    return {name: read_csv(spark, f"{folder}/{file}") for name, file in RATED.items()}


def sibling(path: str, name: str) -> str:
    """Another table's file beside the cleaned ratings."""
    return path.replace(RATED["ratings"], RATED[name])


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all machines share: under spark.checkpoint.dir, in the temporary folder only for a local session without it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        top = os.path.join(tempfile.gettempdir(), "tesserix-files")
    path = f"{top}/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def kept(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written once and read again, so that several users of it don't compute it several times."""
    path = path or f"{shared_folder(df.sparkSession)}/kept"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, which text files can hold."""
    nested = (ArrayType, MapType, StructType)
    return df.select([F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> str:
    flat(df).write.mode("overwrite").options(header=True, quote='"', escape='"', maxRecordsPerFile=FILE_ROWS).csv(path)
    return path


def write_cleaned(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One CSV table <name>_cleaned.csv each."""
    return {name: write_csv(df, f"{folder}/{name}_cleaned.csv") for name, df in tables.items()}


def write_lines(df: DataFrame, column: str, path: str) -> str:
    """A text file with one value of the column a line."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)
    return path


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(StructType([StructField("value", StringType())])).text(path)


def write_report(df: DataFrame, path: str) -> str:
    """A table as tab-separated text with a header."""
    flat(df).write.mode("overwrite").options(header=True, sep="\t", quote='"', escape='"').csv(path)
    return path


def report(title: str, df: DataFrame, most: int = 20) -> str:
    """The first rows as text for a console, under a title; nothing but these rows reaches the driver."""
    rows = df.limit(most).collect()
    cells = [df.columns, *[[f"{x:.4f}" if isinstance(x, float) else str(x) for x in r] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join([title, *["  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in cells]])
