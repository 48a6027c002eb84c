"""The registry of the corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import embedding_dedup, jaccard_join, language, licenses, neighbours, packing, quality, sentencepiece_codec, suffix_dedup, toxicity

QUERIES = {
    "op1_neighbours": neighbours.query,
    "op2_licenses": licenses.query,
    "op3_toxicity": toxicity.query,
    "op4_language": language.query,
    "op5_packing": packing.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_sentencepiece": sentencepiece_codec.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_quality": quality.query,
    "op10_embedding_dedup": embedding_dedup.query,
}

ORACLE_SQL = {"op2_licenses": licenses.oracle()}
