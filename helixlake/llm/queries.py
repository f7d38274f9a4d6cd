"""Queries of the corpus operators, by the names they are registered under."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixlake.llm import chat, decontaminate, language, lm, media, mixing, neardup, passages, pii, quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_language": language.op2_language,
    "op3_neardup": neardup.op3_neardup,
    "op4_quality": quality.op4_quality,
    "op5_mixing": mixing.op5_mixing,
    "op6_lm": lm.op6_lm,
    "op7_chat": chat.op7_chat,
    "op8_media": media.op8_media,
    "op9_pii": pii.op9_pii,
    "op10_passages": passages.op10_passages,
}

#: DuckDB SQL for those queries that SQL can express.
ORACLES: dict[str, str] = {
    "op5_mixing": mixing.ORACLE,
    "op7_chat": chat.ORACLE,
}
