"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logspark.llm.bpe import op6_trie_bpe
from logspark.llm.common import ship
from logspark.llm.jaccard import OP9_SQL, op9_minhash_jaccard_join
from logspark.llm.lattice import OP4_SQL, op4_e8_lattice
from logspark.llm.lines import op3_line_dedup
from logspark.llm.lm import op10_attention_lm
from logspark.llm.merkle import OP11_SQL, op11_merkle_manifest
from logspark.llm.mixing import OP8_SQL, op8_weighted_mixing
from logspark.llm.pii import op2_bootstrapped_pii
from logspark.llm.quality import op1_importance_resampling
from logspark.llm.repair import OP13_SQL, op13_cyk_repair
from logspark.llm.topk import OP7_SQL, op7_kd_tree_topk
from logspark.llm.urls import OP5_SQL, op5_bloom_cascade
from logspark.llm.warc import OP12_SQL, op12_capture_index


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run


QUERIES = (
    op1_importance_resampling, op2_bootstrapped_pii, op3_line_dedup, op4_e8_lattice, op5_bloom_cascade,
    op6_trie_bpe, op7_kd_tree_topk, op8_weighted_mixing, op9_minhash_jaccard_join, op10_attention_lm,
    op11_merkle_manifest, op12_capture_index, op13_cyk_repair,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """The others are beyond SQL; tests/llm holds them against brute force."""
    return {
        "op4_e8_lattice": OP4_SQL, "op5_bloom_cascade": OP5_SQL, "op7_kd_tree_topk": OP7_SQL,
        "op8_weighted_mixing": OP8_SQL, "op9_minhash_jaccard_join": OP9_SQL, "op11_merkle_manifest": OP11_SQL,
        "op12_capture_index": OP12_SQL, "op13_cyk_repair": OP13_SQL,
    }
