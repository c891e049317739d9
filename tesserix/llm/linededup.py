"""Cross-site boilerplate lines: HyperLogLog sketches of the sites of each line hash.

Sketches merge by aggregation, so a line on every site costs a sketch a task and no more. Lines
whose estimate is well above or below the threshold are decided by it; those near the threshold
get exact distinct counts. A line that min_sites sites or more have is boilerplate and goes from
every document, unless the document holds nothing else.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import fresh, stored, table

#: Sites that make a line boilerplate, and the logarithm of a sketch's size.
MIN_SITES, LG_K = 10, 12
LINE = ["h1", "h2"]


def trimmed(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    "))


def hashes(t: Column) -> Column:
    """128 bits of a trimmed line."""
    return F.struct(F.xxhash64(t).alias("h1"), F.xxhash64(t, F.lit(1)).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, h1, h2 of each line that is not blank. White space becomes blanks in the whole text at once, so that no line is rewritten by character."""
    plain = F.coalesce(text, F.lit(""))
    for c in "\t\r\x0b\x0c":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    each = df.select(*keep, F.explode(F.transform(F.split(plain, "\n", -1), lambda x: F.trim(x))).alias("line")).where("line <> ''")
    return each.select(*keep, F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"))


def boilerplate(df: DataFrame, text: str, site: str, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2) of the lines that at least min_sites sites have. A null site is none."""
    named = df.where(F.col(site).isNotNull()).select(F.col(site).cast("string").alias("site"), F.col(text).alias("said"))
    seen = line_hashes(named, "said", "site")
    sketched = seen.groupBy(*LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    # five standard errors and one: outside, the estimate decides
    band = math.ceil(5 * 1.04 / math.sqrt(2**lg_k) * min_sites) + 1
    sketched = stored(sketched.where(F.col("sites") >= min_sites - band))
    near = sketched.where(F.abs(F.col("sites") - min_sites) <= band)
    exact = seen.join(near.select(*LINE), LINE, "left_semi").distinct().groupBy(*LINE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    return stored(sketched.where(F.col("sites") > min_sites + band).select(*LINE).unionByName(exact.select(*LINE)))


def remove_lines(df: DataFrame, bad: DataFrame, text: str = "text") -> DataFrame:
    """df with text less the lines in bad, n_lines and n_removed.

    A document all of whose lines that are not blank would go stays as it is: a copied document
    is not boilerplate. A null text stays null with no lines. Rows that are equal in all columns
    fare alike. Columns of df named n_lines or n_removed are replaced.
    """
    df = df.drop("n_lines", "n_removed")
    k1, k2, gone = fresh(df, "k1", "k2", "gone")
    # copies of a text stand apart by their other columns, so that they don't meet in one task
    other = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, AtomicType)]
    df = df.withColumns({k1: F.xxhash64(*other), k2: F.xxhash64(F.coalesce(text, F.lit("")), F.lit(1))})
    at = line_hashes(df.select(k1, k2, F.col(text).alias("said")), "said", k1, k2)
    found = at.join(bad, LINE).groupBy(k1, k2).agg(F.collect_set(F.struct("h1", "h2")).alias(gone))
    out = df.join(found, [k1, k2], "left")
    lines = lines_of(F.col(text))
    stays = lambda x: ~F.array_contains(F.col(gone), hashes(trimmed(x)))
    kept = F.transform(F.array(F.filter(lines, stays)), lambda k: F.when(F.exists(k, lambda x: trimmed(x) != ""), k).otherwise(lines))[0]
    breaks = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    out = out.withColumn("n_lines", F.coalesce(breaks + 1, F.lit(0)).cast("int")).withColumn(gone, F.when(F.col(gone).isNotNull(), kept))
    new = {"n_removed": F.coalesce(F.col("n_lines") - F.size(gone), F.lit(0)).cast("int"), text: F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(gone, "\n"))}
    return out.withColumns(new).drop(k1, k2, gone)


def dedup_lines(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    return remove_lines(df, boilerplate(df, text, site, min_sites, lg_k), text)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents less the lines, of any length, that ten sources or more have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, text, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
keyed AS (SELECT *, trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ') AS t FROM lines),
bad AS (
  SELECT t FROM keyed WHERE t <> ''
  GROUP BY t HAVING count(DISTINCT source) >= {MIN_SITES}),
parts AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls, (SELECT coalesce(list(t), []) FROM bad) AS b FROM documents),
kept AS (
  SELECT doc_id, text, ls, list_filter(ls, lambda x: NOT list_contains(b, trim(translate(x, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' '))) AS k FROM parts),
safe AS (
  SELECT doc_id, text, ls, CASE WHEN len(list_filter(k, lambda x: trim(translate(x, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ') <> '')) > 0 THEN k ELSE ls END AS k FROM kept)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS INTEGER) AS n_lines, CAST(len(ls) - len(k) AS INTEGER) AS n_removed,
  CASE WHEN text IS NULL THEN NULL ELSE array_to_string(k, chr(10)) END AS text FROM safe
"""
