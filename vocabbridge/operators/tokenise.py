"""Tokenisers: built-in word patterns with a vocabulary table, or any tokenizer library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabbridge.functions.sequences import full_mask, with_special_tokens
from vocabbridge.functions.text import words_and_added
from vocabbridge.operators.lookup import BROADCAST_BYTES, lookup_ids, lookup_values
from vocabbridge.operators.vocabulary import check_vocabulary

# Characters of the texts that a tokenizer library encodes at a time.
ENCODED_CHARS = 1 << 18


def text_column(df: DataFrame) -> str:
    """``text`` if the table has it, else its first column."""
    return "text" if "text" in df.columns else df.columns[0]


def tokenise(
    df: DataFrame,
    vocab: DataFrame,
    pattern: str,
    unknown: int | None = None,
    bos: int | None = None,
    eos: int | None = None,
    row_key: str = "row_idx",
    limit_bytes: int = BROADCAST_BYTES,
    added: list[str] | None = None,
) -> DataFrame:
    """Replace the text by ``input_ids`` and ``attention_mask``.

    ``vocab`` holds ``token`` and ``token_id``.  Words outside it become ``unknown``,
    or are left out if that is None.  ``added`` tokens are cut out of the text before it
    is split into words, and looked up like words.  Nothing is truncated.
    """
    vocab, column = check_vocabulary(vocab), text_column(df)
    ids = lookup_ids(
        df,
        words_and_added(F.col(column), pattern, added or []),
        vocab.select("token", "token_id"),
        "input_ids",
        unknown,
        row_key,
        limit_bytes,
        drop=(column,),
    )
    if bos is not None or eos is not None:
        ids = ids.withColumn("input_ids", with_special_tokens(F.col("input_ids"), bos, eos))
    return typed_tokens(ids)


def typed_tokens(df: DataFrame) -> DataFrame:
    """Declared output types: 32-bit ids and a boolean mask."""
    ids = F.col("input_ids").cast("array<int>")
    mask = (
        F.col("attention_mask").cast("array<boolean>")
        if "attention_mask" in df.columns
        else full_mask(F.col("input_ids"))
    )
    return df.withColumn("input_ids", ids).withColumn("attention_mask", mask)


def _parts(texts: list[str | None], chars: int = ENCODED_CHARS) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about ``chars`` characters, one text at least."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text or "") > chars:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


def library_tokeniser(load: Callable[[], Callable[[list[str]], list[list[int]]]]):
    """Arrow UDF around a tokenizer library.

    ``load`` runs once per Python worker and returns a function from a list of texts
    to a list of id lists.  It gets so few texts at a time that what a library keeps per
    token stays small, whatever the length of the texts in an Arrow batch.
    """

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode_texts = load()
        for texts in batches:
            ids = []
            for part in _parts(texts.tolist()):
                ids.extend(np.asarray(one, np.int32) for one in encode_texts(part))
            yield pd.Series(ids, dtype=object)

    return encode


def token_count(ids: Column) -> Column:
    """Number of ids in a sequence."""
    return F.size(ids)


def decode(
    df: DataFrame,
    vocab: DataFrame,
    ids: str = "input_ids",
    row_key: str = "row_idx",
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows with ``decoded``: the tokens joined with a space, a bare id where unknown.

    A row without ids is decoded to an empty text.
    """
    found = lookup_values(
        df.select(row_key, ids), F.col(ids), vocab.select("token_id", "token"), "_tokens", row_key, limit_bytes
    )
    shown = F.zip_with(ids, "_tokens", lambda i, token: F.coalesce(token, i.cast("string")))
    return found.select(row_key, F.coalesce(F.array_join(shown, " "), F.lit("")).alias("decoded"))
