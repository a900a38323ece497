"""The queries of this folder and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

import corpus_pipeline

from . import (
    compaction,
    conversation_trie,
    exact_dedup,
    hard_negatives,
    license_scan,
    mixing,
    ngram_join,
    packing,
    pivot_dedup,
    secret_ledger,
    substring_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pivot_dedup": pivot_dedup.op3_pivot_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_compaction": compaction.op5_compaction,
    "op6_mixing": mixing.op6_mixing,
    "op7_packing": packing.op7_packing,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_secret_ledger": secret_ledger.op11_secret_ledger,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op11_secret_ledger": secret_ledger.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_conversation_trie": conversation_trie.OP13_SQL,
}
