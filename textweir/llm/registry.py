"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import embedding_dedup, grammar, language_id, minhash, packing, pieces, quality_rules, toxicity, url_filter, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_binary": grammar.op3_token_binary,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_warc": warc.op5_warc,
    "op6_language_id": language_id.op6_language_id,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_minhash": minhash.op8_minhash,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
SQL = {"op5_warc": warc.SQL, "op9_url_filter": url_filter.SQL}
