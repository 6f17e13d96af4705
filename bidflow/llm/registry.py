"""Queries of the corpus operators by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from bidflow.llm import (
    alignment,
    exact_dedup,
    fingerprints,
    language,
    mixing,
    near_dedup,
    passage_dedup,
    pieces,
    substring_dedup,
    token_counts,
    toxicity,
    variants,
    warc,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_language": language.op2_language,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_passage_dedup": passage_dedup.op4_passage_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_warc": warc.op6_warc,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_alignment": alignment.op11_alignment,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_variants": variants.op13_variants,
}
ORACLE = {"op5_exact_dedup": exact_dedup.ORACLE_OP5, "op6_warc": warc.ORACLE_OP6, "op13_variants": variants.ORACLE_OP13}
