"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codetables.llm import (
    bpe_fst, cross_align, embedding_pq, exact_dedup, fingerprints, jaccard_join, langid, packing, prefix_trie, sharding, token_files, toxicity, warc_derive,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": token_files.query,
    "op2_curve_packing": packing.query,
    "op3_jaccard_regions": jaccard_join.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_product_quantisation": embedding_pq.query,
    "op6_warc_derivatives": warc_derive.query,
    "op7_language_bitmask": langid.query,
    "op8_prefix_shards": sharding.query,
    "op9_bpe_transducer": bpe_fst.query,
    "op10_subword_toxicity": toxicity.query,
    "op11_cross_alignment": cross_align.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_parsing_fingerprints": fingerprints.query,
}

ORACLE_SQL: dict[str, str] = {"op4_exact_dedup": exact_dedup.SQL, "op5_product_quantisation": embedding_pq.SQL, "op12_prefix_trie": prefix_trie.SQL}
