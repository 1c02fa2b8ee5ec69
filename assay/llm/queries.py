"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from assay.llm.decontaminate import OP5_SQL, op5_decontaminate
from assay.llm.fill_middle import OP13_SQL, op13_fill_middle
from assay.llm.language_model import op7_language_model
from assay.llm.licenses import OP8_SQL, op8_licenses
from assay.llm.mixing import op6_mixing
from assay.llm.near_dups import OP4_SQL, op4_near_dups
from assay.llm.pieces import op11_pieces
from assay.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from assay.llm.quality_classifier import op9_quality
from assay.llm.quality_rules import op10_quality_rules
from assay.llm.sharding import op2_sharding
from assay.llm.toxicity import op3_toxicity
from assay.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_near_dups": op4_near_dups,
    "op5_decontaminate": op5_decontaminate,
    "op6_mixing": op6_mixing,
    "op7_language_model": op7_language_model,
    "op8_licenses": op8_licenses,
    "op9_quality": op9_quality,
    "op10_quality_rules": op10_quality_rules,
    "op11_pieces": op11_pieces,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fill_middle": op13_fill_middle,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op1_warc": OP1_SQL,
    "op4_near_dups": OP4_SQL,
    "op5_decontaminate": OP5_SQL,
    "op8_licenses": OP8_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_fill_middle": OP13_SQL,
}
