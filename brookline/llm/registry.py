"""The queries of this subpackage and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from brookline.llm import byte_bpe, conversation_trie, exact_dedup, html_text, katz, mixing, packing, quality, repeats, resampling, sharding, similarity_join, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": html_text.query,
    "op2_interleaved_shards": sharding.query,
    "op3_pareto_mix": mixing.query,
    "op4_chosen_path_join": similarity_join.query,
    "op5_merged_bwt_repeats": repeats.query,
    "op6_katz_backoff": katz.query,
    "op7_weak_supervision": quality.query,
    "op8_toxicity_grammar": toxicity.query,
    "op9_dominance_packing": packing.query,
    "op10_extendible_dedup": exact_dedup.query,
    "op11_importance_resampling": resampling.query,
    "op12_byte_bpe": byte_bpe.query,
    "op13_conversation_trie": conversation_trie.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_interleaved_shards": sharding.SQL,
    "op3_pareto_mix": mixing.SQL,
    "op10_extendible_dedup": exact_dedup.SQL,
    "op11_importance_resampling": resampling.SQL,
    "op13_conversation_trie": conversation_trie.SQL,
}
