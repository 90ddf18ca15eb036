"""Queries of this folder by name, and the SQL that DuckDB checks them by where SQL can express them."""

from __future__ import annotations

from . import oracles
from .op1_mixing import op1_mixing
from .op2_quality import op2_quality
from .op3_jaccard import op3_jaccard
from .op4_substring import op4_substring
from .op5_sharding import op5_sharding
from .op6_rules import op6_rules
from .op7_pii import op7_pii
from .op8_decontamination import op8_decontamination

from .op9_html import op9_html
from .op10_chat import ORACLE as CHAT_SQL
from .op10_chat import op10_chat


def queries() -> dict:
    found = (op1_mixing, op2_quality, op3_jaccard, op4_substring, op5_sharding, op6_rules, op7_pii, op8_decontamination, op9_html, op10_chat)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard": oracles.JACCARD, "op4_substring": oracles.SUBSTRING, "op8_decontamination": oracles.DECONTAMINATION, "op10_chat": CHAT_SQL}
