"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import exact_dedup, filter_audit, hard_negatives, line_dedup, warc
from .bpe import op3_byte_bpe
from .exact_dedup import op13_exact_dedup
from .filter_audit import op11_filter_audit
from .fingerprints import op4_fingerprints
from .hard_negatives import op12_hard_negatives
from .language_id import op5_language_id
from .line_dedup import op10_line_dedup
from .packing import op2_packing
from .quality_rules import op8_quality_rules
from .simhash_dedup import op9_simhash_dedup
from .substring_dedup import op1_substring_dedup
from .toxicity import op7_toxicity
from .warc import op6_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_fingerprints": op4_fingerprints,
    "op5_language_id": op5_language_id,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op6_warc": warc.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
}
