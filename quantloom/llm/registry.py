"""Queries of the corpus operators and their DuckDB equivalents."""

from __future__ import annotations

import corpus_pipeline
from quantloom.llm import decontaminate, jaccard_groups, language_mix, licenses, max_sketch, mixing, quality_rules, ring_shards, rule_ensemble, secret_scan, suffix_dedup, token_align, url_filter


def queries():
    return {
        "op1_repeats": suffix_dedup.op1_repeats,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_language": language_mix.op3_language,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_near": jaccard_groups.op5_near,
        "op6_quality": rule_ensemble.op6_quality,
        "op7_licenses": licenses.op7_licenses,
        "op8_secrets": secret_scan.op8_secrets,
        "op9_urls": url_filter.op9_urls,
        "op10_mix": mixing.op10_mix,
        "op11_search": max_sketch.op11_search,
        "op12_align": token_align.op12_align,
        "op13_shards": ring_shards.op13_shards,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op4_decontaminate": decontaminate.OP4_SQL,
        "op5_near": jaccard_groups.OP5_SQL,
        "op9_urls": url_filter.OP9_SQL,
        "op10_mix": mixing.OP10_SQL,
        "op11_search": max_sketch.OP11_SQL,
    }
