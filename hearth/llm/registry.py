"""The text operators' queries and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearth.llm import (
    decontaminate,
    exact_dedup,
    html_text,
    language_id,
    lexical,
    line_dedup,
    near_dedup,
    packing,
    quality,
    secret_scan,
    substring_dedup,
    toxicity,
    variants,
)
from hearth.llm.staging import library_on_workers

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_quality": quality.op4_quality,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_html_text": html_text.op7_html_text,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_spelling_variants": variants.op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op5_secret_scan": secret_scan.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_substring_dedup": substring_dedup.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
    "op13_spelling_variants": variants.ORACLE,
}


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        library_on_workers(spark)
        return query(spark, sf_dir)
    return run


def queries() -> dict[str, Query]:
    return {name: _shipped(q) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
