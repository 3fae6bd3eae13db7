"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from tessera.llm import audit, chat, encoding, html, lm, mixing, neighbours, pipeline, quality, repeats, secrets, segment, simhash, toxicity


def queries():
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_simhash": simhash.op2_simhash,
        "op3_html": html.op3_html,
        "op4_sentencepiece": segment.op4_sentencepiece,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_repeats": repeats.op7_repeats,
        "op8_mixing": mixing.op8_mixing,
        "op9_neighbours": neighbours.op9_neighbours,
        "op10_secret_scans": secrets.op10_secret_scans,
        "op11_filter_audit": audit.op11_filter_audit,
        "op12_target_encoding": encoding.op12_target_encoding,
        "op13_lm_scoring": lm.op13_lm_scoring,
        "pipeline": pipeline.run,
    }


def oracle_sql():
    """Where SQL can express the operator."""
    return {
        "op5_chat_formatting": chat.OP5_SQL,
        "op6_quality_rules": quality.OP6_SQL,
        "op8_mixing": mixing.OP8_SQL,
        "op10_secret_scans": secrets.OP10_SQL,
        "op11_filter_audit": audit.OP11_SQL,
        "op12_target_encoding": encoding.OP12_SQL,
    }
