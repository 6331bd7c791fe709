"""The queries of this package by name, and the SQL of those that SQL can express."""

from . import block_max, divergence, quality_rules
from .balanced import op3_balanced
from .block_max import op13_block_max
from .classifier import op10_classifier
from .debruijn import op5_debruijn
from .divergence import op12_divergence
from .media import op1_media
from .pieces import op6_sentencepiece
from .quality_rules import op2_quality_rules
from .simhash import op9_simhash
from .sstable import op4_sstable
from .suffix_array import op8_suffix_array
from .token_counts import op7_token_counts
from .wrappers import op11_wrappers

QUERIES = {
    "op1_media": op1_media,
    "op2_quality_rules": op2_quality_rules,
    "op3_balanced": op3_balanced,
    "op4_sstable": op4_sstable,
    "op5_debruijn": op5_debruijn,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_array": op8_suffix_array,
    "op9_simhash": op9_simhash,
    "op10_classifier": op10_classifier,
    "op11_wrappers": op11_wrappers,
    "op12_divergence": op12_divergence,
    "op13_block_max": op13_block_max,
}

SQL: dict[str, str] = {"op2_quality_rules": quality_rules.sql(), "op12_divergence": divergence.sql(), "op13_block_max": block_max.sql()}
