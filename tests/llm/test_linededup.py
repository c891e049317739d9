"""Boilerplate lines against a dictionary of sites."""

from collections import defaultdict

import duckdb
from conftest import SMALL, folder
from pyspark.sql import functions as F

from tesserix.llm import linededup

BLANK = str.maketrans("\t\r\x0b\x0c", "    ")


def brute(rows, least=10):
    trim = lambda x: x.translate(BLANK).strip(" ")
    sites = defaultdict(set)
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            if r["source"] is not None and trim(x):
                sites[trim(x)].add(r["source"])
    bad = {t for t, s in sites.items() if len(s) >= least}
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if trim(x) not in bad]
        kept = kept if any(trim(x) for x in kept) else lines
        out.append((r["doc_id"], 0 if r["text"] is None else len(lines), len(lines) - len(kept), None if r["text"] is None else "\n".join(kept)))
    return sorted(out, key=str)


def result(df, **how):
    return sorted([tuple(r) for r in linededup.dedup_lines(df, **how).select("doc_id", "n_lines", "n_removed", "text").collect()], key=str)


def test_edge_rows(edge):
    assert result(edge) == brute(edge.collect())
    assert any(r[2] for r in result(edge))
    assert result(edge, min_sites=2) == brute(edge.collect(), 2)


def test_query_and_its_sql(spark, small):
    got = sorted([tuple(r) for r in linededup.op3_line_dedup(spark, SMALL).select("doc_id", "n_lines", "n_removed", "text").collect()], key=str)
    assert got == brute(small.collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert got == sorted(db.sql(linededup.OP3_SQL).fetchall(), key=str)


def test_near_the_threshold(spark):
    """Lines on 6 to 16 sites, each several times."""
    rows = [(k * 100 + i, f"line {k}\nown {k} {i}", f"s{i % k}") for k in range(6, 17) for i in range(3 * k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert result(df) == brute(df.collect())


def test_spaces_and_long_lines(spark):
    line = "  a\t b " + "c  " * 20
    long, spaced = "w " * 50 + "w", "w  " * 49 + "w"
    rows = [(i, f"{line}\r\n{long}\n{spaced}\nown {i}", f"s{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert result(df) == brute(df.collect())


def test_empty_and_clashes(edge, none):
    assert linededup.dedup_lines(none).collect() == []
    odd = edge.withColumns({"line": F.lit("x"), "h1": F.lit(1), "said": F.lit(2), "site": F.lit("q"), "__gone": F.lit(3), "n_lines": F.lit(9)})
    assert result(odd) == brute(edge.collect())
