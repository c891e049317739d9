"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, collision, linededup, media, minhash, mixing, packing, sharding, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_suffix_dedup": suffixes.op4_suffix_dedup,
    "op5_chat": chat.op5_chat,
    "op6_minhash": minhash.op6_minhash,
    "op7_packing": packing.op7_packing,
    "op8_media": media.op8_media,
    "op9_ann": collision.op9_ann,
    "op10_sharding": sharding.op10_sharding,
}

#: Those that SQL expresses. The others are tested against brute force in tests/llm.
SQL: dict[str, str] = {"op3_line_dedup": linededup.OP3_SQL, "op5_chat": chat.OP5_SQL}
