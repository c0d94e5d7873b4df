"""Token-id lines and paired token-id rows for the vector fit and the evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabbridge.functions.sequences import ids_to_line
from vocabbridge.operators.rowindex import head_rows

# Shortest rows taken when the stages run together.
MIN_TOKENS_TRAIN = 0
MIN_TOKENS_EVAL = 10


def _head(tokens: DataFrame, max_lines: int | None, index: str) -> DataFrame:
    return tokens if max_lines is None else head_rows(tokens, max_lines, index)


def token_lines(
    tokens: DataFrame, min_tokens: int = 15, max_lines: int | None = None, index: str = "split_idx"
) -> DataFrame:
    """``line`` for each row that is long enough, among the first ``max_lines`` if given.

    The head limit counts rows before the length filter.
    """
    return (
        _head(tokens, max_lines, index)
        .where(F.size("input_ids") >= min_tokens)
        .select(index, ids_to_line(F.col("input_ids")).alias("line"))
    )


def paired_rows(
    source: DataFrame,
    target: DataFrame,
    min_tokens: int = 15,
    max_lines: int | None = None,
    index: str = "split_idx",
) -> DataFrame:
    """``sample_id, src_ids, tgt_ids`` of rows at the same position in two tokenisations.

    Both sides must have the same number of rows; rows too short on either side are
    dropped after the head limit, if there is one.
    """
    n_source, n_target = source.count(), target.count()
    if n_source != n_target:
        raise ValueError(f"cannot pair {n_source} source rows with {n_target} target rows")
    left = _head(source, max_lines, index).select(
        F.col(index).alias("sample_id"), F.col("input_ids").alias("src_ids")
    )
    right = _head(target, max_lines, index).select(
        F.col(index).alias("sample_id"), F.col("input_ids").alias("tgt_ids")
    )
    long_enough = (F.size("src_ids") >= min_tokens) & (F.size("tgt_ids") >= min_tokens)
    return left.join(right, "sample_id").where(long_enough)


def split_name(key: str) -> str:
    """The split a key names; ``valid`` is short for ``validation``."""
    if key in ("train", "validation", "test"):
        return key
    if key == "valid":
        return "validation"
    raise ValueError(f"no export for {key!r}")
