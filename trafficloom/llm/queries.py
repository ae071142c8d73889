"""Queries of this subpackage and their DuckDB equivalents, for __spark_entry__.py."""

from __future__ import annotations

from .chat import OP7_SQL, op7_chat_format
from .licenses import OP4_SQL, op4_license_scan
from .mixing import OP10_SQL, op10_mixing
from .bit_codes import op8_bit_code_search
from .packing import op9_packing
from .pivot_index import OP3_SQL, op3_exact_top_k
from .pii import op1_personal_data
from .revisits import OP6_SQL, op6_revisit_resolution
from .simhash import op2_simhash_groups
from .toxicity import op5_toxicity

QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_simhash_groups": op2_simhash_groups,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_license_scan": op4_license_scan,
    "op5_toxicity": op5_toxicity,
    "op6_revisit_resolution": op6_revisit_resolution,
    "op7_chat_format": op7_chat_format,
    "op8_bit_code_search": op8_bit_code_search,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {
    "op3_exact_top_k": OP3_SQL,
    "op4_license_scan": OP4_SQL,
    "op6_revisit_resolution": OP6_SQL,
    "op7_chat_format": OP7_SQL,
    "op10_mixing": OP10_SQL,
}
