"""The numbered operators' queries and their SQL, for the entry module."""

from __future__ import annotations

from .ann_tree import op6_ann_tree
from .byte_bpe import op7_byte_bpe
from .chat_format import op1_chat_format
from .decontaminate import op3_decontaminate
from .hard_negatives import op13_hard_negatives
from .html_text import op8_html_text
from .jaccard_join import op5_jaccard_join
from .language_id import op9_language_id
from .oracles import ORACLE_SQL
from .quality_trees import op12_quality_trees
from .spelling import op11_spelling_variants
from .suffix_dedup import op2_suffix_dedup
from .token_counts import op10_token_counts
from .token_files import op4_token_files

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_suffix_dedup,
        op3_decontaminate,
        op4_token_files,
        op5_jaccard_join,
        op6_ann_tree,
        op7_byte_bpe,
        op8_html_text,
        op9_language_id,
        op10_token_counts,
        op11_spelling_variants,
        op12_quality_trees,
        op13_hard_negatives,
    )
}
__all__ = ["ORACLE_SQL", "QUERIES"]
