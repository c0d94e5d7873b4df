"""Every operator as a query over the given tables, with the SQL that checks it."""

from __future__ import annotations

from vocabbridge.catalog import (
    alignment,
    corpus,
    evaluation,
    files,
    journey,
    model,
    packing,
    tokens,
    vectors,
)

MODULES = [corpus, tokens, packing, vectors, alignment, evaluation, model, journey, files]


def all_queries() -> dict:
    """Name to callable of (spark, folder of the tables)."""
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    """Name to the SQL that gives the same rows."""
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
