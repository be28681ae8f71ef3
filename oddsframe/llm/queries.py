"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str, module: str, function: str) -> Query:
    """A query that applies one operator to one whole table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"oddsframe.llm.{module}"), function)(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    return query


def _with(second: str, module: str, function: str) -> Query:
    """A query that applies one operator to all documents and a second table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", second)]
        return getattr(import_module(f"oddsframe.llm.{module}"), function)(*tables)

    return query


QUERIES: dict[str, Query] = {
    "op1_html_extract": _table("pages", "extract", "extract_main_text"),
    "op2_exact_dedup": _table("documents", "exact_dedup", "exact_groups"),
    "op3_decontaminate": _with("benchmark", "decontaminate", "find_leaks"),
    "op4_simhash": _table("documents", "simhash", "simhash_components"),
    "op5_url_filter": _table("pages", "url_filter", "judge_urls"),
    "op6_language_id": _table("documents", "langid", "identify"),
    "op7_chat_format": _table("conversations", "chat", "format_chats"),
    "op8_toxicity": _with("labels", "toxicity", "score_toxicity"),
    "op9_packing": _table("documents", "packing", "pack"),
    "op10_secrets": _table("documents", "secrets", "find_secrets"),
    "op11_vector_codes": _table("embeddings", "vector_codes", "compress"),
    "op12_golden_records": _table("clients", "survivorship", "golden_records"),
    "op13_source_mix": _table("documents", "mixing", "mix"),
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256 from d join g using (t)
""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from oddsframe.llm import chat, mixing, survivorship, vector_codes

    return ORACLES | {"op7_chat_format": chat.ORACLE_SQL, "op11_vector_codes": vector_codes.ORACLE_SQL, "op12_golden_records": survivorship.ORACLE_SQL, "op13_source_mix": mixing.ORACLE_SQL}
