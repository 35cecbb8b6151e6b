"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tickloom.llm import ann_forest, bpe, decontam, exact_dedup, html_region, ngram_join, quality_gam, resampling, secrets, token_files, token_fsm, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontam.op1_decontamination,
        "op2_token_files": token_files.op2_token_files,
        "op3_byte_bpe": bpe.op3_byte_bpe,
        "op4_token_counts": token_fsm.op4_token_counts,
        "op5_quality": quality_gam.op5_quality,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_nearest": ann_forest.op7_nearest,
        "op8_html_text": html_region.op8_html_text,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_secrets": secrets.op10_secrets,
        "op11_exact_dedup": exact_dedup.op11_exact_dedup,
        "op12_resampling": resampling.op12_resampling,
        "op13_whitening": whitening.op13_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontam.OP1_SQL, "op11_exact_dedup": exact_dedup.OP11_SQL}
