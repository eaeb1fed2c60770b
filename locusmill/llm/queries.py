"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP11_SQL, op11_trie_collocations
from .mixing import OP10_SQL, op10_hierarchical_budgets
from .neardup import op4_setsketch_minhash
from .passages import op2_collinear_passages
from .pieces import op5_offset_pieces
from .pii import op9_anchor_expansion
from .preferences import OP6_SQL, op6_preference_pairs
from .quality import op1_quality_rules
from .topk import OP7_SQL, op7_bit_sliced_topk
from .urls import OP3_SQL, op3_redirect_equivalence
from .weaklabels import op8_weak_label_quality
from .whitening import op13_whitening
from .wordtable import op12_word_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_collinear_passages,
        op3_redirect_equivalence,
        op4_setsketch_minhash,
        op5_offset_pieces,
        op6_preference_pairs,
        op7_bit_sliced_topk,
        op8_weak_label_quality,
        op9_anchor_expansion,
        op10_hierarchical_budgets,
        op11_trie_collocations,
        op12_word_table,
        op13_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_redirect_equivalence": OP3_SQL,
    "op6_preference_pairs": OP6_SQL,
    "op7_bit_sliced_topk": OP7_SQL,
    "op10_hierarchical_budgets": OP10_SQL,
    "op11_trie_collocations": OP11_SQL,
}
