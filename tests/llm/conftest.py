"""Small tables for the corpus operators: the driver's smallest ones and one of edge cases."""

from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows() -> list[tuple]:
    prose = " ".join(f"w{i % 97}x{i * 7 % 13}" for i in range(400))
    other = " ".join(f"y{i}" for i in range(300))
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (4, "one", "en", "b", 3), (5, "One", "en", "b", 3),
        (6, prose, "en", "a", 1), (7, prose, "en", "b", 1), (8, prose + " tail", "en", None, 1), (9, "head " + prose.upper(), "fr", "c", 1),
        (10, other, "en", "a", 1), (11, other + "\n" + other, "en", "a", 1), (12, "naïve été ñandú 日本語 \U0001f600 don't it's <|endoftext|> 12  x y", "es", "d", 1),
        (13, other[:700] + " 日本 " + prose[:600], "en", "a", 1), (None, "no id at all here", "en", "a", 1), (None, prose, "en", "a", 1), (None, None, None, None, None),
        (14, "same line\nonly\n\nsame line", "en", "a", 1), (14, "same line\nonly\n\nsame line", "en", "a", 1), (15, "z" * 5000, "en", "e", 1), (16, "z" * 399, "en", "e", 1), (17, "q r s t", "en", "e", 1),
        (20, "a b c d e f g h", "en", "f", 1), (21, "A b\tc d e f g\nh", "en", "f", 1),
    ]
    return [*rows, *[(100 + i, f"shared footer line\nunique {i} words here", "en", f"site{i}", 1) for i in range(12)]]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def folder(spark, where: Path, **tables) -> str:
    """Tables as a folder that queries read."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{where}/{name}.parquet")
    return str(where)
