"""What the corpus operators share."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from tesserix.llm.common import BATCH, ROWS, gathered, small_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_to_python_are_bounded(spark):
    before = spark.conf.get(KEY)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]) for b in batches)
    try:
        spark.conf.set(KEY, "64m")
        small_batches(spark)
        rows = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) AS text").mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in rows) == 40 and len(rows) > 5 and max(r.size for r in rows) < BATCH + 2_000_000
        spark.conf.set(KEY, "1m")
        small_batches(spark)
        assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.set(KEY, before)


FREED = """
import re
import pyarrow as pa
from tesserix.llm.common import BATCH, lean, lean_group

def held_mb():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

pins = []

def litter():  # frees 150 MB of small pieces, of which the last stays, so that the heap's end is in use
    made = [bytes(1500) for _ in range(100_000)]
    pins.append(made[-1])

def run(batches):
    for batch in batches:
        litter()
        yield batch

def group(rows):
    litter()
    return rows

batch = pa.RecordBatch.from_arrays([pa.array(["x" * BATCH])], names=["text"])
rows, before = pa.Table.from_batches([batch]), held_mb()
assert list(lean(run)(iter([batch]))) == [batch] and held_mb() < before + 60
assert lean_group(group)(rows) is rows and held_mb() < before + 60
list(run(iter([batch])))
assert held_mb() > before + 100  # what the test is about
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="reads Linux's own figures")
def test_freed_memory_goes_back():
    """In a process of its own, as other tests' leavings count too."""
    subprocess.run([sys.executable, "-c", FREED], check=True, timeout=60)


def test_few_rows_have_few_partitions(spark):
    df = spark.range(0, 1000, 1, 8)
    assert gathered(df, 1000).rdd.getNumPartitions() == 1 and gathered(df, ROWS + 1).rdd.getNumPartitions() == 2
    assert gathered(df, 1 << 60) is df and gathered(df, 0).count() == 1000
