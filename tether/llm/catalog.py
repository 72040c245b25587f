"""The queries of this subpackage, by name."""

from __future__ import annotations

from tether.llm import oracles
from tether.llm import queries_chat as c
from tether.llm import queries_dedup as d
from tether.llm import queries_tables as t
from tether.llm import queries_tokens as k


def queries():
    return {
        "op1_minhash_dedup": d.op1_minhash_dedup,
        "op2_language_id": t.op2_language_id,
        "op3_best_fit_packing": k.op3_best_fit_packing,
        "op4_entropy_mix": t.op4_entropy_mix,
        "op5_rule_quality": t.op5_rule_quality,
        "op6_interleaved_media": t.op6_interleaved_media,
        "op7_int8_embedding_dedup": d.op7_int8_embedding_dedup,
        "op8_suffix_dedup": d.op8_suffix_dedup,
        "op9_tool_call_chat": c.op9_tool_call_chat,
        "op10_edit_aware_counts": k.op10_edit_aware_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": oracles.OP1, "op7_int8_embedding_dedup": oracles.OP7}
