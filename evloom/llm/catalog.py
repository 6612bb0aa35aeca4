"""Queries of the training-data operators and their DuckDB SQL where there is one."""

from __future__ import annotations

from . import bpe, chat_format, embedding_dedup, mixing, packing, quality_classifier, quality_rules, simhash, source_audit, spelling, suffix_dedup, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_chat_format": chat_format.query,
        "op2_bpe": bpe.query,
        "op3_packing": packing.query,
        "op4_toxicity": toxicity.query,
        "op5_suffix_dedup": suffix_dedup.query,
        "op6_embedding_dedup": embedding_dedup.query,
        "op7_quality_classifier": quality_classifier.query,
        "op8_simhash": simhash.query,
        "op9_url_filter": url_filter.query,
        "op10_quality_rules": quality_rules.query,
        "op11_source_audit": source_audit.query,
        "op12_mixing": mixing.query,
        "op13_spelling": spelling.query,
    }


def oracle_sql() -> dict:
    return {
        "op1_chat_format": chat_format.SQL,
        "op5_suffix_dedup": suffix_dedup.SQL,
        "op6_embedding_dedup": embedding_dedup.SQL,
        "op9_url_filter": url_filter.SQL,
        "op10_quality_rules": quality_rules.SQL,
        "op11_source_audit": source_audit.SQL,
        "op12_mixing": mixing.SQL,
    }
