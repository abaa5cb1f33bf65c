"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, filter_audit, importance, mixing, ngrams, quality, secrets, sentencepieces, sharding, simhash, suffixes, token_counts, topk

QUERIES = {
    "op1_ngrams": ngrams.query,
    "op2_sentencepiece": sentencepieces.query,
    "op3_sharding": sharding.query,
    "op4_simhash": simhash.query,
    "op5_quality": quality.query,
    "op6_topk": topk.query,
    "op7_suffixes": suffixes.query,
    "op8_secrets": secrets.query,
    "op9_token_counts": token_counts.query,
    "op10_decontamination": decontamination.query,
    "op11_mixing": mixing.query,
    "op12_filter_audit": filter_audit.query,
    "op13_importance": importance.query,
}

ORACLE_SQL = {
    "op6_topk": topk.SQL,
    "op7_suffixes": suffixes.SQL,
    "op10_decontamination": decontamination.SQL,
    "op11_mixing": mixing.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
