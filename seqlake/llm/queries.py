"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqlake.llm import alignment, brown, chat, decontaminate, divergence, langid, mixing, neardup, oracles, pii, quality, secrets, substring, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_adaptive_quality": quality.op1_adaptive_quality,
    "op2_warc_zstd": warc.op2_warc_zstd,
    "op3_brown_classes": brown.op3_brown_classes,
    "op4_pareto_mix": mixing.op4_pareto_mix,
    "op5_perspective_rotation": chat.op5_perspective_rotation,
    "op6_script_viterbi": langid.op6_script_viterbi,
    "op7_aho_corasick": decontaminate.op7_aho_corasick,
    "op8_setsketch": neardup.op8_setsketch,
    "op9_fingerprint_index": substring.op9_fingerprint_index,
    "op10_disclosure": pii.op10_disclosure,
    "op11_segment_alignment": alignment.op11_segment_alignment,
    "op12_token_efficiency": secrets.op12_token_efficiency,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_adaptive_quality": quality.OP1_SQL,
    "op2_warc_zstd": oracles.OP2_SQL,
    "op5_perspective_rotation": chat.OP5_SQL,
    "op7_aho_corasick": decontaminate.op7_sql(),
    "op8_setsketch": oracles.OP8_SQL,
    "op9_fingerprint_index": oracles.OP9_SQL,
    "op10_disclosure": oracles.OP10_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
