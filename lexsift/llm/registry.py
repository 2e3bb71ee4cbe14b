"""Queries and oracle SQL of this subpackage, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, chat, htmlcrf, linededup, mixing, neardup, pieces, quality, sharding, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_count_pretokens": tokens.op1_count_pretokens,
        "op2_chroma_alignment": audio.op2_chroma_alignment,
        "op3_simhash_pigeonring": neardup.op3_simhash_pigeonring,
        "op4_shard_by_bytes": sharding.op4_shard_by_bytes,
        "op5_mix_packed_blocks": mixing.op5_mix_packed_blocks,
        "op6_line_windows": linededup.op6_line_windows,
        "op7_distinct_chunks": pieces.op7_distinct_chunks,
        "op8_crf_blocks": htmlcrf.op8_crf_blocks,
        "op9_perplexity_bands": quality.op9_perplexity_bands,
        "op10_rotate_perspectives": chat.op10_rotate_perspectives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_shard_by_bytes": sharding.OP4_SQL,
        "op5_mix_packed_blocks": mixing.OP5_SQL,
        "op6_line_windows": linededup.OP6_SQL,
        "op10_rotate_perspectives": chat.OP10_SQL,
    }
