"""Registered queries of the numbered operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import ship, table
from .chat import chat_query
from .exact import EXACT_SQL, exact_query
from .forest import near_query
from .langid import language_query
from .mix import MIX_SQL, mix_query
from .pack import pack
from .phrases import PHRASES_SQL, collocations
from .pieces import pieces_query
from .ranked import RANKED_SQL, ranked_query
from .suffix import passages_query
from .tokenfile import token_files_query
from .topk import TOP_K_SQL, top_k_query
from .warc import warc_query

Query = Callable[[SparkSession, str], DataFrame]


def over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    """The operator over a whole table of the folder."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return operator(table(spark, sf_dir, name))

    return query


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ranked_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_top_k": over("embeddings", top_k_query),
    "op2_language_id": over("documents", language_query),
    "op3_chat_format": over("conversations", chat_query),
    "op4_repeated_passages": over("documents", passages_query),
    "op5_near_dedup": over("documents", near_query),
    "op6_token_files": over("documents", token_files_query),
    "op7_exact_dedup": over("documents", exact_query),
    "op8_source_mix": over("documents", mix_query),
    "op9_best_fit_packing": over("documents", pack),
    "op10_warc": over("pages", warc_query),
    "op11_pieces": over("documents", pieces_query),
    "op12_ranked_search": ranked,
    "op13_collocations": over("documents", collocations),
}

ORACLE: dict[str, str] = {
    "op1_top_k": TOP_K_SQL,
    "op7_exact_dedup": EXACT_SQL,
    "op8_source_mix": MIX_SQL,
    "op12_ranked_search": RANKED_SQL,
    "op13_collocations": PHRASES_SQL,
}
