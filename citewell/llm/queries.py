"""Queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from citewell.llm import conversations, fixity, language, lattice_lm, main_text, mixing, near_dedup, oracles, order_minhash, packing, prefix_forest, quality, secrets, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merkle_audit": fixity.op1,
        "op2_fair_mix": mixing.op2,
        "op3_prefix_forest": prefix_forest.op3,
        "op4_mixture_language": language.op4,
        "op5_order_minhash": order_minhash.op5,
        "op6_trigram_secrets": secrets.op6,
        "op7_lattice_likelihood": lattice_lm.op7,
        "op8_rule_ensemble": quality.op8,
        "op9_odd_sketch": near_dedup.op9,
        "op10_bin_completion": packing.op10,
        "op11_best_stretch": main_text.op11,
        "op12_role_repair": conversations.op12,
        "op13_part_codes": vector_codes.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = oracles.oracle_sql() | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in found.items() if v}
