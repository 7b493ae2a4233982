"""The corpus pipeline: language ID, exact and near deduplication, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and works on all rows that the one before
it kept, whole texts, with their columns. ``run`` writes each stage's result as Parquet in the shared folder and reads it
again, so a lost executor repeats work of one stage only. Empty input gives empty output at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shrinkfit.llm.common import ship, table
from shrinkfit.llm.exact import drop_exact_copies
from shrinkfit.llm.forest import drop_near_copies
from shrinkfit.llm.langid import keep_identified
from shrinkfit.llm.mix import mix_sources
from shrinkfit.llm.pack import pack
from shrinkfit.session import materialize

CAPACITY = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go (operator 2)."""
    ship(spark)
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id (operator 7)."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, five-word shingles, Jaccard of 0.8 or more (operator 5)."""
    ship(spark)
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (operator 8)."""
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences (operator 9)."""
    ship(spark)
    return pack(docs, CAPACITY)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", packing)]

#: Language ID, near deduplication and packing can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
