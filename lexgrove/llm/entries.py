"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontam, jaccard_tree, langid_gru, media_audio, packing, pfp_dedup, quality_fm, toxicity, zm_parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontam.query,
    "op2_jaccard_join": jaccard_tree.query,
    "op3_toxicity": toxicity.query,
    "op4_media": media_audio.query,
    "op5_langid": langid_gru.query,
    "op6_lm_scoring": zm_parse.query,
    "op7_packing": packing.query,
    "op8_chat": chat_format.query,
    "op9_quality": quality_fm.query,
    "op10_suffix_dedup": pfp_dedup.query,
}

ORACLE: dict[str, str] = {"op8_chat": chat_format.ORACLE_SQL}
