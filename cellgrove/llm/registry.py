"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from cellgrove.llm.decontamination import OP7_SQL, op7_decontamination
from cellgrove.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from cellgrove.llm.line_dedup import OP2_SQL, op2_line_dedup
from cellgrove.llm.mixing import OP1_SQL, op1_mix_sources
from cellgrove.llm.ngram_join import op6_ngram_jaccard_join
from cellgrove.llm.packing import op13_best_fit_packing
from cellgrove.llm.pii import op8_pii
from cellgrove.llm.quality_classifier import op4_quality_classifier
from cellgrove.llm.quality_rules import op5_quality_rules
from cellgrove.llm.sharding import op3_shuffle_shards
from cellgrove.llm.spelling import OP11_SQL, op11_spelling_variants
from cellgrove.llm.substring_dedup import op10_substring_dedup
from cellgrove.llm.warc import OP9_SQL, op9_warc_chunks

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_line_dedup": op2_line_dedup,
    "op3_shuffle_shards": op3_shuffle_shards,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_decontamination": op7_decontamination,
    "op8_pii": op8_pii,
    "op9_warc_chunks": op9_warc_chunks,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_best_fit_packing": op13_best_fit_packing,
}
ORACLES = {
    "op1_mix_sources": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op7_decontamination": OP7_SQL,
    "op9_warc_chunks": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
}
