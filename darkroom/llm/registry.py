"""Queries and SQL of this subpackage, by the names that the entry module registers."""

from __future__ import annotations

import corpus_pipeline
from darkroom.llm import ann, collocations, conversations, decontam, html_text, line_dedup, mixing, near_dedup, packing, quality, simple8b, suffix_dedup, toxicity


def queries() -> dict:
    """All queries of the operators and the pipeline."""
    return {
        "op1_token_ids": simple8b.op1_token_ids,
        "op2_mixing_sources": mixing.op2_mixing_sources,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_nearest_neighbours": ann.op5_nearest_neighbours,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
        "op9_html_extraction": html_text.op9_html_extraction,
        "op10_packing": packing.op10_packing,
        "op11_benchmark_decontamination": decontam.op11_benchmark_decontamination,
        "op12_phrase_collocations": collocations.op12_phrase_collocations,
        "op13_conversation_repair": conversations.op13_conversation_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {
        "op2_mixing_sources": mixing.OP2_SQL, "op7_quality_rules": quality.OP7_SQL, "op11_benchmark_decontamination": decontam.OP11_SQL,
        "op12_phrase_collocations": collocations.OP12_SQL, "op13_conversation_repair": conversations.OP13_SQL,
    }
