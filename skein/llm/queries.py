"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from skein.llm.bpe import op9_bpe_tree
from skein.llm.chat import op1_chat_windows
from skein.llm.fingerprints import op5_bloom_lookup_sketch
from skein.llm.jaccard import op7_adaptive_prefix_join
from skein.llm.maxent import op2_class_maxent
from skein.llm.oracles import ORACLES  # noqa: F401
from skein.llm.packing import op4_variable_best_fit
from skein.llm.pii import op10_semi_markov_pii
from skein.llm.quality import op6_weak_supervision
from skein.llm.shards import op3_minimax_shards
from skein.llm.suffix import op8_prefix_doubling

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_windows,
        op2_class_maxent,
        op3_minimax_shards,
        op4_variable_best_fit,
        op5_bloom_lookup_sketch,
        op6_weak_supervision,
        op7_adaptive_prefix_join,
        op8_prefix_doubling,
        op9_bpe_tree,
        op10_semi_markov_pii,
    )
}
