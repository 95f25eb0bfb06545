"""The subpackage's queries by name, and SQL of those that SQL can express."""

from __future__ import annotations

from siftstone.llm import (
    chat_format,
    extendible_shards,
    merkle_manifest,
    ngram_join,
    ngram_ratio,
    quality_zstd,
    secret_scan,
    source_mix,
    template_leaks,
    token_file,
    toxicity,
    vector_topk,
    whitening,
)

QUERIES = {
    "op1_chat_formatting": chat_format.op1_query,
    "op2_sharding": extendible_shards.op2_query,
    "op3_secret_scan": secret_scan.op3_query,
    "op4_source_mix": source_mix.op4_query,
    "op5_toxicity": toxicity.op5_query,
    "op6_decontamination": template_leaks.op6_query,
    "op7_exact_topk": vector_topk.op7_query,
    "op8_token_file": token_file.op8_query,
    "op9_quality": quality_zstd.op9_query,
    "op10_ngram_join": ngram_join.op10_query,
    "op11_merkle_manifest": merkle_manifest.op11_query,
    "op12_quality_rules": ngram_ratio.op12_query,
    "op13_whitening": whitening.op13_query,
}
ORACLE_SQL = {
    "op1_chat_formatting": chat_format.OP1_SQL,
    "op2_sharding": extendible_shards.op2_sql(),
    "op7_exact_topk": vector_topk.OP7_SQL,
    "op10_ngram_join": ngram_join.OP10_SQL,
    "op11_merkle_manifest": merkle_manifest.OP11_SQL,
}
