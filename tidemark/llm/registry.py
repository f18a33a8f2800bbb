"""Registered queries of the training-data operators."""

from __future__ import annotations

from . import bpe, decontaminate, fingerprint, lang_id, near_dup, pii, quality, secrets, token_count, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_fingerprint": fingerprint.op2_fingerprint,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_bpe": bpe.op4_bpe,
        "op5_near_dup": near_dup.op5_near_dup,
        "op6_lang_id": lang_id.op6_lang_id,
        "op7_quality": quality.op7_quality,
        "op8_token_count": token_count.op8_token_count,
        "op9_pii": pii.op9_pii,
        "op10_secrets": secrets.op10_secrets,
    }


def oracle_sql() -> dict:
    return {"op1_url_filter": url_filter.ORACLE, "op3_decontaminate": decontaminate.ORACLE, "op5_near_dup": near_dup.ORACLE, "op9_pii": pii.ORACLE, "op10_secrets": secrets.ORACLE}
