"""The driver's contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_corpus_operators(tmp_path):
    """A copy without them still imports and registers the other queries."""
    shutil.copytree(ROOT / "tesserix", tmp_path / "tesserix", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mdl2_cf_recommendations' in q and 'pipeline' not in q and not any(x.startswith('op1_') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
