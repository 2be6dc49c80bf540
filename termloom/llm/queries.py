"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import ann, archives, conversations, fill_middle, fingerprints, mixing, ngram_join, pitman_yor, quality, sentencepieces, token_files, toxicity, wrappers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ann": ann.op1, "op2_wrappers": wrappers.op2, "op3_sentencepieces": sentencepieces.op3, "op4_fingerprints": fingerprints.op4, "op5_archives": archives.op5, "op6_ngram_join": ngram_join.op6, "op7_pitman_yor": pitman_yor.op7, "op8_mixing": mixing.op8, "op9_quality": quality.op9, "op10_token_files": token_files.op10, "op11_toxicity": toxicity.op11, "op12_fill_middle": fill_middle.op12, "op13_conversations": conversations.op13}


def oracle_sql() -> dict[str, str]:
    return {"op5_archives": archives.ORACLE, "op8_mixing": mixing.ORACLE, "op12_fill_middle": fill_middle.ORACLE, "op13_conversations": conversations.ORACLE}
