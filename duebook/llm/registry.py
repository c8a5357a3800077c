"""The subpackage's queries and their SQL, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from duebook.llm.common import table

#: query name: (module, function of the operator's thin query, table)
OPERATORS = {
    "op1_token_counts": ("token_counts", "op1", "documents"),
    "op2_chat_format": ("chat_format", "op2", "conversations"),
    "op3_fertility_rules": ("fertility", "op3", "documents"),
    "op4_html_consensus": ("html_main", "op4", "pages"),
    "op5_sentencepiece": ("sp_backend", "op5", "documents"),
    "op6_jaccard_join": ("jaccard_join", "op6", "documents"),
    "op7_pii_deobfuscation": ("pii", "op7", "documents"),
    "op8_adaptive_scan": ("ann", "op8", "embeddings"),
    "op9_kd_shards": ("kd_shards", "op9", "documents"),
    "op10_mix_sources": ("mixing", "op10", "documents"),
    "op11_prefix_trie": ("prefix_trie", "op11", "conversations"),
    "op12_periodic_runs": ("periodic_runs", "op12", "documents"),
    "op13_license_scan": ("license_scan", "op13", "documents"),
}


def _query(module: str, function: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    run = getattr(import_module(f"duebook.llm.{module}"), function)
    return lambda spark, sf_dir: run(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(*at) for name, at in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    from duebook.llm import chat_format, mixing, prefix_trie

    return {"op2_chat_format": chat_format.SQL, "op10_mix_sources": mixing.SQL, "op11_prefix_trie": prefix_trie.SQL}
