"""Queries of the subpackage and their SQL oracles."""

from __future__ import annotations

import corpus_pipeline
from linkloom.llm import (
    chat_collapse,
    chat_repair,
    decontaminate,
    discriminant,
    edit_counts,
    gru_lm,
    jaccard_join,
    packing,
    prefix_trie,
    quality,
    substring_dedup,
    token_store,
    url_filter,
)


def queries() -> dict:
    return {
        "op1_token_store": token_store.query,
        "op2_packing": packing.query,
        "op3_decontaminate": decontaminate.query,
        "op4_quality_rules": quality.query,
        "op5_suffix_dedup": substring_dedup.query,
        "op6_jaccard_join": jaccard_join.query,
        "op7_chat_collapse": chat_collapse.query,
        "op8_edit_counts": edit_counts.query,
        "op9_url_filter": url_filter.query,
        "op10_gru_lm": gru_lm.query,
        "op11_discriminant": discriminant.query,
        "op12_chat_repair": chat_repair.query,
        "op13_prefix_trie": prefix_trie.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op4_quality_rules": quality.sql(),
        "op7_chat_collapse": chat_collapse.SQL,
        "op9_url_filter": url_filter.SQL,
    }
