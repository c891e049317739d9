"""What the corpus operators share: reading tables, cutting lineage, fresh column names."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of a batch that goes to Python.
BATCH = 4 << 20
#: Short rows (a few numbers) that are worth a partition of their own.
ROWS = 100_000
#: Rows of a group after which memory is given back.
GROUP = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share. Only without a setting (a local session) a temporary one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    made = tempfile.mkdtemp(prefix="tesserix-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of a batch that goes to Python by BATCH; a smaller bound of the session stays.

    A batch stands in an executor several times over (as vectors, as a message and in Python), for
    each of its tasks. Batches are only how rows travel: results don't depend on them.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH:
        spark.conf.set(key, str(BATCH))


def give_back() -> None:
    """Returns to the system what this process has freed; without glibc, only what Arrow has."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with give_back() at the end: workers live on after a task, beside an executor's other work, and keep what they have freed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run for applyInArrow, with give_back() after large groups: a quarter of BATCH, or GROUP rows."""

    def whole(rows: pa.Table) -> pa.Table:
        out = run(rows)
        if rows.nbytes >= BATCH // 4 or rows.num_rows >= GROUP:
            give_back()
        return out

    return whole


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many rows, in no more partitions than they call for: each costs a task and a file with every cut()."""
    parts = max(1, -(-rows // ROWS))
    return df.repartition(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: later steps neither recompute it nor need its executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
        forget_later(spark, spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of steps that are over: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """df written once as Parquet in the shared folder and read again: what cut() does, in less space."""
    path = path or f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    forget_later(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_later(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the driver ends: results are lazy, so until then it may be read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(text: Column) -> Column:
    """A text's UTF-8 bytes; none for null."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """A public tokenizer's file: in folder if given, else where its package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
