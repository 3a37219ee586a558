"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from assayer.llm import byte_pairs, embeddings, importance, jaccard, licences, negatives, packing, pieces, quality_model, quality_rules, substrings, suffixes, toxicity

QUERIES = {
    "op1_embedding_dedup": embeddings.op1_embedding_dedup,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_packing": packing.op4_packing,
    "op5_license_scan": licences.op5_license_scan,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_model": quality_model.op9_quality_model,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_importance": importance.op12_importance,
    "op13_byte_pairs": byte_pairs.op13_byte_pairs,
}
ORACLES: dict[str, str] = {
    "op1_embedding_dedup": embeddings.OP1_SQL,
    "op6_substring_dedup": substrings.OP6_SQL,
    "op10_jaccard_join": jaccard.OP10_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_importance": importance.OP12_SQL,
}
