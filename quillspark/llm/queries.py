"""The corpus queries and their SQL."""

from __future__ import annotations

from quillspark.llm import bpe, conversation_repair, decontaminate, exact_dedup, jaccard_join, lexical_search, passage_dedup, quality, sharding, string_dedup, token_counts, toxicity, vector_dedup

QUERIES = {
    "op1_bpe_round_trip": bpe.op1,
    "op2_suffix_dedup": string_dedup.op2,
    "op3_exact_dedup": exact_dedup.op3,
    "op4_byte_shards": sharding.op4,
    "op5_decontamination": decontaminate.op5,
    "op6_token_counts": token_counts.op6,
    "op7_quality_rules": quality.op7,
    "op8_jaccard_join": jaccard_join.op8,
    "op9_passage_dedup": passage_dedup.op9,
    "op10_toxicity_fm": toxicity.op10,
    "op11_vector_dedup": vector_dedup.op11,
    "op12_lexical_search": lexical_search.op12,
    "op13_conversation_repair": conversation_repair.op13,
}

ORACLE_SQL = {
    "op2_suffix_dedup": string_dedup.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op9_passage_dedup": passage_dedup.ORACLE,
    "op11_vector_dedup": vector_dedup.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
}
