"""All queries on the reference's side: name -> function and name -> SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.plans import conversation, documents, search, service, streams, tools

FLAGSHIP = "topk_hybrid"
_ALL = search.QUERIES | conversation.QUERIES | service.QUERIES | documents.QUERIES | streams.QUERIES | tools.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
