"""Expressions on arrays of token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ids_to_line(ids: Column) -> Column:
    """Decimal ids joined with one space."""
    return F.array_join(ids.cast("array<string>"), " ")


def line_to_ids(line: Column) -> Column:
    """Inverse of :func:`ids_to_line`; an empty line is an empty array."""
    return F.when(line == "", F.array().cast("array<int>")).otherwise(
        F.split(line, " ").cast("array<int>")
    )


def with_special_tokens(ids: Column, bos: int | None = None, eos: int | None = None) -> Column:
    """Add a tokenizer's start and end ids, where it has them."""
    parts = [F.array(F.lit(bos))] if bos is not None else []
    parts.append(ids)
    if eos is not None:
        parts.append(F.array(F.lit(eos)))
    return F.concat(*parts)


def full_mask(ids: Column) -> Column:
    """Attention mask of an unpadded sequence: true for each id."""
    return F.array_repeat(F.lit(True), F.size(ids))


def has_length(ids: Column, n: int) -> Column:
    """``ids`` itself; the query fails on a sequence of any other length."""
    return F.when(F.size(ids) == n, ids).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {n} token ids, found "), F.size(ids)))
    )
