"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes all rows that the one before kept. All but the last return
the columns of ``documents``; the last returns one row per packed piece.

1. ``language_id``: documents without letters, or whose text no learned
   language explains, go.
2. ``line_dedup``: of lines or runs of lines of 5 words or more that repeat,
   the first occurrence stays; the texts are rewritten.
3. ``near_dedup``: one document of each near-duplicate class stays.
4. ``decontamination``: documents that hold a passage of ``benchmark`` go.
5. ``packing``: the rest is packed into sequences of 1024 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearth.llm.decontaminate import drop_contaminated
from hearth.llm.language_id import held_out_by, keep_identified, sample_text
from hearth.llm.line_dedup import drop_repeated_lines
from hearth.llm.near_dedup import drop_near_copies
from hearth.llm.packing import pack
from hearth.llm.staging import library_on_workers, stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    library_on_workers(spark)
    samples = sample_text(docs.filter(~held_out_by("doc_id", 4, 2)), "doc_id", "text", "lang")
    return keep_identified(docs, samples)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    library_on_workers(spark)
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    library_on_workers(spark)
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    library_on_workers(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    library_on_workers(spark)
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Several stages are beyond SQL (suffix automata, weighted sampling, byte-level
# BPE); tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
