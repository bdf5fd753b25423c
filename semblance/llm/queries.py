"""Queries of the training-data operators, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from semblance.llm import collocation, conversations, html, katz, media, mixing, neardup, packing, quality, sharding, toxicity, urls, warc

QUERIES = {
    "op1_html_extraction": html.op1_html_extraction,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_packing": packing.op4_packing,
    "op5_media_columns": media.op5_media_columns,
    "op6_mixing": mixing.op6_mixing,
    "op7_near_dedup": neardup.op7_near_dedup,
    "op8_url_filters": urls.op8_url_filters,
    "op9_sharding": sharding.op9_sharding,
    "op10_lm_scoring": katz.op10_lm_scoring,
    "op11_collocations": collocation.op11_collocations,
    "op12_warc": warc.op12_warc,
    "op13_conversations": conversations.op13_conversations,
}

ORACLE_SQL = {
    "op2_quality_rules": quality.OP2_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op8_url_filters": urls.OP8_SQL,
    "op11_collocations": collocation.OP11_SQL,
    "op12_warc": warc.OP12_SQL,
}
