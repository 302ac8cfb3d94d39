"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language import op8_language
from .licenses import OP5_SQL, op5_licenses
from .mixing import OP1_SQL, op1_mixing
from .packing import op2_packing
from .quality import op7_quality
from .rabitq import OP3_SQL, op3_rabitq
from .repetition import OP6_SQL, op6_repetition
from .simhash import op4_simhash
from .token_counts import op9_token_counts
from .toxicity import op12_toxicity
from .url_rules import OP10_SQL, op10_url_rules
from .whitening import op13_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_packing, op3_rabitq, op4_simhash, op5_licenses, op6_repetition, op7_quality, op8_language,
        op9_token_counts, op10_url_rules, op11_hard_negatives, op12_toxicity, op13_whitening,
    )
}
SQL = {
    "op1_mixing": OP1_SQL, "op3_rabitq": OP3_SQL, "op5_licenses": OP5_SQL, "op6_repetition": OP6_SQL,
    "op10_url_rules": OP10_SQL, "op11_hard_negatives": OP11_SQL,
}
