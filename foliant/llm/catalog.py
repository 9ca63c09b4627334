"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from foliant.llm import ann, bpe, decontaminate, html_text, line_dedup, sharding, simhash, token_counts, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_bpe": bpe.query,
        "op2_decontaminate": decontaminate.query,
        "op3_sharding": sharding.query,
        "op4_token_counts": token_counts.query,
        "op5_ann": ann.query,
        "op6_line_dedup": line_dedup.query,
        "op7_url_filter": url_filter.query,
        "op8_toxicity": toxicity.query,
        "op9_html_text": html_text.query,
        "op10_simhash": simhash.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.SQL, "op3_sharding": sharding.SQL, "op6_line_dedup": line_dedup.SQL, "op7_url_filter": url_filter.SQL}
