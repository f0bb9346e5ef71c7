"""Queries of the operators in this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from geoloom.llm import divergence, edits, fixity, mixing, negatives, pieces, quality, secrets, simhash, topk, toxicity, training_order, urls


def queries() -> dict:
    return {
        "op1_warc_fixity": fixity.op1_warc_fixity,
        "op2_mixing": mixing.op2_mixing,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_training_order": training_order.op4_training_order,
        "op5_secrets": secrets.op5_secrets,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_sentencepiece": pieces.op7_sentencepiece,
        "op8_edit_fingerprints": edits.op8_edit_fingerprints,
        "op9_simhash": simhash.op9_simhash,
        "op10_url_filters": urls.op10_url_filters,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_exact_topk": topk.op12_exact_topk,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_fixity": fixity.OP1_SQL,
        "op2_mixing": mixing.OP2_SQL,
        "op10_url_filters": urls.OP10_SQL,
        "op11_source_divergence": divergence.OP11_SQL,
        "op12_exact_topk": topk.OP12_SQL,
        "op13_hard_negatives": negatives.OP13_SQL,
    }
