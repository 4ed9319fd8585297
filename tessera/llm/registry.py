"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontaminate import op9_decontaminate
from .language import op4_language_id
from .oracles import OP1, OP2, OP9
from .packing import op6_packing
from .quality import op10_quality_rules
from .secrets import op8_secret_scans
from .simhash import op3_simhash
from .substrings import op2_substrings
from .suffixes import op7_suffix_array
from .token_counts import op5_token_counts
from .warc import op1_warc_index

QUERIES = {f.__name__: f for f in (op1_warc_index, op2_substrings, op3_simhash, op4_language_id, op5_token_counts, op6_packing, op7_suffix_array, op8_secret_scans, op9_decontaminate, op10_quality_rules)}
SQL: dict[str, str] = {"op1_warc_index": OP1, "op2_substrings": OP2, "op9_decontaminate": OP9}
