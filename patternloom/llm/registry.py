"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from patternloom.llm import op01_decontamination, op02_jaccard_join, op03_packing, op04_toxicity, op05_secrets, op06_licenses, op07_embeddings, op08_substrings, op09_sharding, op10_urls, op11_filter_audit, op12_conversations, op13_tokens, sql

QUERIES = {
    "op1_benchmark_decontamination": op01_decontamination.query,
    "op2_jaccard_join": op02_jaccard_join.query,
    "op3_packing": op03_packing.query,
    "op4_toxicity": op04_toxicity.query,
    "op5_secrets": op05_secrets.query,
    "op6_licenses": op06_licenses.query,
    "op7_embedding_dedup": op07_embeddings.query,
    "op8_substring_dedup": op08_substrings.query,
    "op9_sharding": op09_sharding.query,
    "op10_url_filter": op10_urls.query,
    "op11_filter_audit": op11_filter_audit.query,
    "op12_conversation_repair": op12_conversations.query,
    "op13_token_counts": op13_tokens.query,
}

ORACLE_SQL = {
    "op1_benchmark_decontamination": sql.DECONTAMINATION,
    "op2_jaccard_join": sql.JACCARD,
    "op7_embedding_dedup": sql.EMBEDDINGS,
    "op8_substring_dedup": sql.SUBSTRINGS,
    "op10_url_filter": sql.URLS,  # for tables whose pages hold no canonical link and no redirect, as all those given
    "op11_filter_audit": sql.AUDIT,
    "op12_conversation_repair": sql.CONVERSATIONS,
}
