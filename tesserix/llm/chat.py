"""Multi-party chat formatting with the perspective rotated over the participants.

For every participant the dialogue is rendered with that speaker as the assistant and the others
as named users; system turns stay system turns. Long dialogues are cut into consecutive chunks of
TURNS turn numbers, so that no group grows without bound; every turn is in one chunk of each
perspective, and every chunk after the one that has it begins with the dialogue's opening system turn.
The mask says which characters the model learns: those of the assistant's own turns. Marks within
texts and names are escaped, so that no text can pass for a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Turn numbers in a chunk.
TURNS = 64
NOBODY = "unknown"


def escaped(said: Column) -> Column:
    """No mark can begin or end in it."""
    return F.replace(F.replace(said, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def rotate(df: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", turns: int = TURNS) -> DataFrame:
    """One row a conversation, chunk and participant: conv_id, chunk, perspective, n_turns, text, mask.

    mask is a list of (start, length) character spans of text, of the perspective's own turns with
    their end marks. Participants are all speakers but "system", over the whole conversation; in
    chunks where one has no turn, all its mask is empty. A null speaker is called "unknown", a
    null text is empty, a null turn comes before all others in chunk 0, a null conversation id is
    a conversation of its own. Turns of the same number are ordered by speaker and text; repeated
    rows are repeated turns. The opening system turn is the first of the conversation's; n_turns
    counts it where a chunk repeats it. Conversations of system turns only have no participants and so no
    rows. Other columns are left out. An empty df gives an empty result.
    """
    rows = df.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker).cast("string"), F.lit(NOBODY)).alias("speaker"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("said")
    ).withColumn("chunk", F.floor(F.coalesce("turn", F.lit(0)) / turns).cast("long"))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "said"))).alias("turns"))
    opening = rows.where("speaker = 'system'").groupBy(F.col("conv_id").alias("oc")).agg(F.min(F.struct("turn", "speaker", "said", "chunk")).alias("o"))
    chunks = chunks.join(opening, F.col("conv_id").eqNullSafe(F.col("oc")), "left")
    first = F.array(F.struct("o.turn", "o.speaker", "o.said"))
    chunks = chunks.select("conv_id", "chunk", F.when(F.col("chunk") <= F.coalesce("o.chunk", "chunk"), F.col("turns")).otherwise(F.concat(first, "turns")).alias("turns"))
    parts = rows.where("speaker <> 'system'").select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    both = chunks.join(parts, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("perspective")
    shown = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit("<|"), F.when(t["speaker"] == own, F.lit("assistant")).when(t["speaker"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), escaped(t["speaker"]))), F.lit("|>\n")).alias("head"),
            F.concat(escaped(t["said"]), F.lit("<|end|>\n")).alias("body"),
            (t["speaker"] == own).alias("own"),
        ),
    )
    span = F.aggregate(
        "shown",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("at"),
            F.when(x["own"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    out = both.withColumn("shown", shown).withColumn("mask", span)
    return out.select("conv_id", "chunk", "perspective", F.size("turns").alias("n_turns"), F.array_join(F.transform("shown", lambda x: F.concat(x["head"], x["body"])), "").alias("text"), "mask")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans as text: start+length, comma-separated."""
    out = rotate(table(spark, sf_dir, "conversations"))
    return out.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("+"), m["length"].cast("string"))), ","))


OP5_SQL = f"""
WITH q AS (
  SELECT conv_id, turn, coalesce(role, '{NOBODY}') AS speaker, coalesce(text, '') AS said,
    CAST(floor(coalesce(turn, 0) / {TURNS}) AS BIGINT) AS chunk FROM conversations),
o AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS rn FROM q WHERE speaker = 'system') WHERE rn = 1),
r AS (
  SELECT *, false AS again FROM q UNION ALL
  SELECT o.conv_id, o.turn, o.speaker, o.said, c.chunk, true FROM o JOIN (SELECT DISTINCT conv_id, chunk FROM q) c ON o.conv_id IS NOT DISTINCT FROM c.conv_id AND c.chunk > o.chunk),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
s AS (
  SELECT r.conv_id, chunk, perspective, again, turn, speaker, said, speaker = perspective AS own,
    '<|' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
      ELSE 'user name=' || replace(replace(speaker, '<|', '<\\|'), '|>', '|\\>') END || '|>' || chr(10) AS head,
    replace(replace(said, '<|', '<\\|'), '|>', '|\\>') || '<|end|>' || chr(10) AS body
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
a AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (
    PARTITION BY conv_id, chunk, perspective ORDER BY again DESC, turn NULLS FIRST, speaker, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s)
SELECT conv_id, chunk, perspective, CAST(count(*) AS INTEGER) AS n_turns,
  string_agg(head || body, '' ORDER BY again DESC, turn NULLS FIRST, speaker, said) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(pos + length(head) AS VARCHAR) || '+' || CAST(length(body) AS VARCHAR) END, ',' ORDER BY again DESC, turn NULLS FIRST, speaker, said), '') AS mask
FROM a GROUP BY conv_id, chunk, perspective
"""
