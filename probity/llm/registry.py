"""Queries and SQL of this subpackage, by query name."""

from __future__ import annotations

from probity.llm import blocks, decontaminate, lines, mixing, neardup, ngrams, oracles, phrases, quality, sharding, toxicity


def queries() -> dict:
    return {
        "op1_html_blocks": blocks.op1_html_blocks,
        "op2_toxicity_fm": toxicity.op2_toxicity_fm,
        "op3_phrase_automata": phrases.op3_phrase_automata,
        "op4_rendezvous_sharding": sharding.op4_rendezvous_sharding,
        "op5_pfair_mix": mixing.op5_pfair_mix,
        "op6_line_quality": quality.op6_line_quality,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_odd_sketch_neardup": neardup.op9_odd_sketch_neardup,
        "op10_trie_lm": ngrams.op10_trie_lm,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_rendezvous_sharding": oracles.op4(),
        "op6_line_quality": oracles.op6(),
        "op7_line_dedup": oracles.op7(),
        "op8_decontamination": oracles.op8(),
    }
