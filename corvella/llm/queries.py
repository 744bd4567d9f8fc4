"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bitplanes, decision_list, decontaminate, hard_negatives, impact_search, jaccard_join, mixing, prefix_bpe, substring_dedup, tool_calls, toxicity, warc_derivatives, wordpiece_counts

QUERIES = {
    "op1_context_mixing": mixing.op1,
    "op2_warc_derivatives": warc_derivatives.op2,
    "op3_decision_list": decision_list.op3,
    "op4_tool_calls": tool_calls.op4,
    "op5_suffix_decontamination": decontaminate.op5,
    "op6_toxicity": toxicity.op6,
    "op7_bitplane_ids": bitplanes.op7,
    "op8_prefix_bpe": prefix_bpe.op8,
    "op9_jaccard_fragments": jaccard_join.op9,
    "op10_longest_match_counts": wordpiece_counts.op10,
    "op11_impact_ordered": impact_search.op11,
    "op12_level_doubling": substring_dedup.op12,
    "op13_score_sort": hard_negatives.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_derivatives": warc_derivatives.OP2_SQL,
    "op5_suffix_decontamination": decontaminate.OP5_SQL,
    "op11_impact_ordered": impact_search.op11,
    "op11_impact_ordered": impact_search.OP11_SQL,
    "op12_level_doubling": substring_dedup.OP12_SQL,
    "op13_score_sort": hard_negatives.OP13_SQL,
}
