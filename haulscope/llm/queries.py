"""The registered queries of this subpackage and the SQL they are checked with, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from haulscope.llm import divergence, lines, negatives, personal, shingles, suffixes, topk
from haulscope.llm.caps import op10_cap_links
from haulscope.llm.chunks import op8_chunk_dedup
from haulscope.llm.divergence import op12_source_divergence
from haulscope.llm.language import op9_language
from haulscope.llm.lines import op2_line_dedup
from haulscope.llm.mixing import op4_mix_sources
from haulscope.llm.negatives import op13_hard_negatives
from haulscope.llm.packing import op3_pack_sequences
from haulscope.llm.personal import op11_personal_data
from haulscope.llm.shingles import op5_ngram_join
from haulscope.llm.suffixes import op7_suffix_dedup
from haulscope.llm.topk import op1_top_k
from haulscope.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_line_dedup": op2_line_dedup,
    "op3_pack_sequences": op3_pack_sequences,
    "op4_mix_sources": op4_mix_sources,
    "op5_ngram_join": op5_ngram_join,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_chunk_dedup": op8_chunk_dedup,
    "op9_language": op9_language,
    "op10_cap_links": op10_cap_links,
    "op11_personal_data": op11_personal_data,
    "op12_source_divergence": op12_source_divergence,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op1_top_k": topk.ORACLE,
    "op2_line_dedup": lines.ORACLE,
    "op5_ngram_join": shingles.ORACLE,
    "op7_suffix_dedup": suffixes.ORACLE,
    "op11_personal_data": personal.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
