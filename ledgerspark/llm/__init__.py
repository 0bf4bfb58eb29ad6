"""Operators of a training-data pipeline. Nothing else in the package imports them."""

from __future__ import annotations


def queries() -> dict:
    from . import bpe, chat, decontaminate, divergence, fim, fingerprints, lm, neardup, packing, pii, quality, secrets_scan, urls

    return {
        "op3_fingerprint": fingerprints.op3_fingerprint,
        "op5_lm_score": lm.op5_lm_score,
        "op8_near_dup": neardup.op8_near_dup,
        "op10_quality": quality.op10_quality,
        "op1_pack": packing.op1_pack,
        "op2_secret_scan": secrets_scan.op2_secret_scan,
        "op4_chat_format": chat.op4_chat_format,
        "op6_pii": pii.op6_pii,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op9_url_filter": urls.op9_url_filter,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_fill_in_middle": fim.op12_fill_in_middle,
        "op13_decontaminate": decontaminate.op13_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    from . import chat, decontaminate, divergence, fim, urls

    return {
        "op4_chat_format": chat.ORACLE,
        "op9_url_filter": urls.ORACLE,
        "op11_source_divergence": divergence.ORACLE,
        "op12_fill_in_middle": fim.ORACLE,
        "op13_decontaminate": decontaminate.ORACLE,
    }
