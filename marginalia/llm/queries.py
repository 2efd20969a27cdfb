"""Queries of this subpackage, by name, and their DuckDB SQL where there is one."""

from __future__ import annotations

import corpus_pipeline
from marginalia.llm import (
    bloom_sketch,
    ftrl_toxicity,
    histogram_packing,
    html_blocks,
    license_digest,
    line_dedup,
    pareto_mix,
    positional_index,
    rule_ensemble,
    simhash_variants,
    token_alignment,
    token_counts,
    turn_repair,
)

QUERIES = {
    "op1_bloom_sketch": bloom_sketch.query,
    "op2_positional_index": positional_index.query,
    "op3_rule_quality": rule_ensemble.query,
    "op4_ftrl_toxicity": ftrl_toxicity.query,
    "op5_pareto_mix": pareto_mix.query,
    "op6_token_counts": token_counts.query,
    "op7_license_digest": license_digest.query,
    "op8_line_dedup": line_dedup.query,
    "op9_simhash_near_duplicates": simhash_variants.query,
    "op10_html_blocks": html_blocks.query,
    "op11_segment_alignment": token_alignment.query,
    "op12_histogram_packing": histogram_packing.query,
    "op13_turn_repair": turn_repair.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op2_positional_index": positional_index.ORACLE_SQL,
    "op5_pareto_mix": pareto_mix.ORACLE_SQL,
    "op7_license_digest": license_digest.ORACLE_SQL,
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op13_turn_repair": turn_repair.ORACLE_SQL,
}
