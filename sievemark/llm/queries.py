"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontaminate, langid, licenses, mixing, neardup, quality, repetition, tokenids, urls

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_url_filter": urls.op3_url_filter,
    "op4_language_id": langid.op4_language_id,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_ngram_jaccard_join": neardup.op6_ngram_jaccard_join,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_token_ids": tokenids.op8_token_ids,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_quality_rules": repetition.op10_quality_rules,
}
ORACLE_SQL = {"op1_chat_formatting": chat.OP1_SQL, "op5_source_mixing": mixing.OP5_SQL, "op6_ngram_jaccard_join": neardup.OP6_SQL, "op10_quality_rules": repetition.OP10_SQL}
