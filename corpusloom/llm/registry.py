"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from corpusloom.llm import exact_dedup, filter_audit, jaccard_join, language_model, line_dedup, media, mixing, packing, quality, simhash, source_divergence, substring, toxicity


def queries():
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_media": media.op2_media,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_mixing": mixing.op4_mixing,
        "op5_packing": packing.op5_packing,
        "op6_quality": quality.op6_quality,
        "op7_language_model": language_model.op7_language_model,
        "op8_substring": substring.op8_substring,
        "op9_simhash": simhash.op9_simhash,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_jaccard_join": jaccard_join.op11_jaccard_join,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_source_divergence": source_divergence.op13_source_divergence,
    }


def oracle_sql():
    return {"op8_substring": substring.SQL, "op10_exact_dedup": exact_dedup.SQL, "op12_filter_audit": filter_audit.SQL, "op13_source_divergence": source_divergence.SQL}
