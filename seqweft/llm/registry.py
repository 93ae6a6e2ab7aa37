"""Queries of the corpus operators: one for each operator, over its whole table."""

from __future__ import annotations

from importlib import import_module

from seqweft.plans.registry import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = ["near_queries", "language_queries", "url_queries", "private_queries", "line_queries", "quality_queries", "token_queries", "warc_queries", "unit_queries", "leak_queries", "negative_queries", "lexical_queries", "toxicity_queries"]


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load_all() -> None:
    for name in MODULES:
        import_module(f"seqweft.llm.{name}")
