"""The operators' queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from tracefold.llm import byte_bpe, chat, embedding_dedup, language_id, line_dedup, media, near_dedup, packing, repeats, toxicity

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_language_id": language_id.op3_language_id,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_suffix_dedup": repeats.op5_suffix_dedup,
    "op6_minhash_near_dedup": near_dedup.op6_minhash_near_dedup,
    "op7_embedding_near_dedup": embedding_dedup.op7_embedding_near_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_chat_format": chat.op10_chat_format,
}
ORACLES = {
    "op6_minhash_near_dedup": near_dedup.ORACLE,
    "op7_embedding_near_dedup": embedding_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_chat_format": chat.ORACLE,
}
