"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, exact_dedup, line_dedup, mixing, near_dedup, packing, sharding, suffix_dedup, topk, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_minimax_shards": sharding.op4_minimax_shards,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pack": packing.op6_pack,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_top_k": topk.op9_top_k,
    "op10_perspectives": chat.op10_perspectives,
}

#: The others are tested against brute force: SQL has no such steps, or is too slow on whole tables.
SQL = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op9_top_k": topk.OP9_SQL,
    "op10_perspectives": chat.OP10_SQL,
}
