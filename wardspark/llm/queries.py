"""Queries of this subpackage by name, and their SQL where SQL can state them."""

from __future__ import annotations

from wardspark.llm import media, mixing, neardup, packing, quality, secrets, tokencount, topk, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_media": media.op3_media,
    "op4_quality": quality.op4_quality,
    "op5_tokens": tokencount.op5_tokens,
    "op6_packing": packing.op6_packing,
    "op7_neardup": neardup.op7_neardup,
    "op8_warc": warc.op8_warc,
    "op9_secrets": secrets.op9_secrets,
    "op10_topk": topk.op10_topk,
}

ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_topk": topk.OP10_SQL,
}
