"""Queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import op8_pii as _op8
from . import op11_lexical as _op11
from . import op12_licenses as _op12
from . import op13_trie as _op13
from .op1_pfor import op1_pfor
from .op2_toxicity import op2_toxicity
from .op3_line_dedup import op3_line_dedup
from .op4_decontam import op4_decontam
from .op5_ngram_join import op5_ngram_join
from .op6_packing import op6_packing
from .op7_html import op7_html
from .op8_pii import op8_pii
from .op9_near_vectors import op9_near_vectors
from .op10_token_counts import op10_token_counts
from .op11_lexical import op11_lexical
from .op12_licenses import op12_licenses
from .op13_trie import op13_trie

QUERIES = {f.__name__: f for f in (op1_pfor, op2_toxicity, op3_line_dedup, op4_decontam, op5_ngram_join, op6_packing, op7_html, op8_pii, op9_near_vectors, op10_token_counts, op11_lexical, op12_licenses, op13_trie)}

ORACLES: dict[str, str] = {"op8_pii": _op8.ORACLE, "op11_lexical": _op11.ORACLE, "op12_licenses": _op12.ORACLE, "op13_trie": _op13.ORACLE}
