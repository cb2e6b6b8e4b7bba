"""From raw documents to packed token sequences: languages, quality, near copies, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hushlake.llm.cost_packing import packed
from hushlake.llm.host_rules import drop_low_quality
from hushlake.llm.language import drop_unidentified
from hushlake.llm.simhash import drop_near_duplicates
from hushlake.llm.suffixes import drop_repeats
from hushlake.plans.storage import materialize
from hushlake.sources.tables import table

#: Each stage takes the session, what the stage before kept, and the folder of the input tables.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", lambda spark, docs, sf_dir: drop_unidentified(docs)),
    ("quality", lambda spark, docs, sf_dir: drop_low_quality(docs)),
    ("near_copies", lambda spark, docs, sf_dir: drop_near_duplicates(docs)),
    ("repeats", lambda spark, docs, sf_dir: drop_repeats(docs)),
    ("packing", lambda spark, docs, sf_dir: packed(docs)),
]

#: SQL expresses neither the language model nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
