"""All registered queries of the library and the SQL that each is held against.

A query module has ``QUERIES``: name -> (function of (spark, sf_dir), SQL or None).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_aggregate, queries_closing, queries_documents, queries_graph, queries_index, queries_more, queries_named, queries_relational, queries_search

MODULES = (queries_aggregate, queries_relational, queries_search, queries_graph, queries_documents, queries_more, queries_closing, queries_named, queries_index)


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return {name: pair for module in MODULES for name, pair in module.QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
