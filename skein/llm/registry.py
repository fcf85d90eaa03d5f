"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from skein.llm.ann_tree import op10_ann_tree
from skein.llm.byte_bpe import op2_byte_bpe
from skein.llm.context_tree import op3_context_tree
from skein.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from skein.llm.filter_audit import OP13_SQL, op13_filter_audit
from skein.llm.matroska import op7_matroska
from skein.llm.mixing import OP1_SQL, op1_mixing
from skein.llm.near_duplicates import op8_near_duplicates
from skein.llm.orc_tokens import op12_orc_tokens
from skein.llm.quality import op4_quality
from skein.llm.secret_scan import op9_secret_scan
from skein.llm.token_counts import op6_token_counts
from skein.llm.toxicity import op5_toxicity


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_context_tree": op3_context_tree,
        "op4_quality": op4_quality,
        "op5_toxicity": op5_toxicity,
        "op6_token_counts": op6_token_counts,
        "op7_matroska": op7_matroska,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_secret_scan": op9_secret_scan,
        "op10_ann_tree": op10_ann_tree,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_orc_tokens": op12_orc_tokens,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op11_conversation_repair": OP11_SQL, "op13_filter_audit": OP13_SQL}
