"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, ctw, decontam, lines, quality, setsketch, shard, suffix, toxic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_setsketch_dedup": setsketch.op1_setsketch_dedup,
    "op2_aho_decontam": decontam.op2_aho_decontam,
    "op3_ctw_score": ctw.op3_ctw_score,
    "op4_bpe_automaton": bpe.op4_bpe_automaton,
    "op5_suffix_dedup": suffix.op5_suffix_dedup,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_feistel_shard": shard.op7_feistel_shard,
    "op8_crf_toxicity": toxic.op8_crf_toxicity,
    "op9_chat_format": chat.op9_chat_format,
    "op10_quality_rules": quality.op10_quality_rules,
}

ORACLES: dict[str, str] = {"op2_aho_decontam": decontam.OP2_SQL, "op10_quality_rules": quality.OP10_SQL}
