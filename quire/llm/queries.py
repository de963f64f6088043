"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from quire.llm import bpe, chat, exact_dedup, language_id, license_scan, mixing, near_dedup, pii, secrets, topk


def queries() -> dict:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_pii": pii.op2_pii,
        "op3_mixing": mixing.op3_mixing,
        "op4_secrets": secrets.op4_secrets,
        "op5_topk_search": topk.op5_topk_search,
        "op6_bpe": bpe.op6_bpe,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_language_id": language_id.op8_language_id,
        "op9_minhash_dedup": near_dedup.op9_minhash_dedup,
        "op10_license_scan": license_scan.op10_license_scan,
        "language_id_pages": language_id.language_id_pages,
    }


def oracle_sql() -> dict:
    return {
        "op1_chat_format": chat.ORACLE,
        "op3_mixing": mixing.ORACLE,
        "op5_topk_search": topk.ORACLE,
        "op7_exact_dedup": exact_dedup.ORACLE,
    }
