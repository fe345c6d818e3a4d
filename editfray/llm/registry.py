"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import bpe, char_lm, embedding_dedup, hard_negatives, html_text, line_dedup, merkle, mixing, ngram_join, sharding, token_counts, topk_search, toxicity

_MODULES = {
    "op1_embedding_dedup": embedding_dedup,
    "op2_token_counts": token_counts,
    "op3_html_text": html_text,
    "op4_line_dedup": line_dedup,
    "op5_ngram_join": ngram_join,
    "op6_source_mixing": mixing,
    "op7_language_id": char_lm,
    "op8_byte_bpe": bpe,
    "op9_toxicity": toxicity,
    "op10_topk_search": topk_search,
    "op11_merkle_manifest": merkle,
    "op12_sharding": sharding,
    "op13_hard_negatives": hard_negatives,
}
QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLES = {name: module.ORACLE for name, module in _MODULES.items() if hasattr(module, "ORACLE")}
