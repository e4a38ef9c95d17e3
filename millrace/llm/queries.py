"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from millrace.llm import bpe, chat, fingerprint, knn, line_dedup, mixing, ngram_join, token_counts, toxicity, wrapper

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_html_extract": wrapper.op3_html_extract,
    "op4_bpe": bpe.op4_bpe,
    "op5_fingerprint": fingerprint.op5_fingerprint,
    "op6_knn": knn.op6_knn,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_chat_format": chat.op10_chat_format,
}
ORACLE_SQL = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op10_chat_format": chat.OP10_SQL,
}
