"""What the queries share: tables, stage outputs written once, and SQL for the same stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocabbridge.operators import evaluate
from vocabbridge.plans import stages
from vocabbridge.storage import SMALL, stored

_STAGES: dict[tuple[str, str, str], object] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(spark: SparkSession, folder: str, name: str, build: Callable):
    """A stage's output, built on first use by a session and then read from where it was written."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STAGES:
        _STAGES[key] = build()
    return _STAGES[key]


def prepared(spark, folder) -> DataFrame:
    return stage(
        spark, folder, "prepared",
        lambda: stages.prepare(table(spark, folder, "documents")),
    )


def source(spark, folder) -> stages.Tokenised:
    return stage(spark, folder, "source", lambda: stages.tokenise_source(prepared(spark, folder)))


def target(spark, folder) -> stages.Tokenised:
    return stage(spark, folder, "target", lambda: stages.tokenise_target(prepared(spark, folder)))


def pairs(spark, folder) -> DataFrame:
    return stage(
        spark, folder, "pairs",
        lambda: stored(stages.evaluation_pairs(source(spark, folder), target(spark, folder)), "pairs", compression=SMALL),
    )


def overlap(spark, folder) -> DataFrame:
    return stage(
        spark, folder, "overlap",
        lambda: stored(stages.overlap_alignment(source(spark, folder), target(spark, folder)), "overlap", compression=SMALL),
    )


def mapped(spark, folder) -> DataFrame:
    return stage(
        spark, folder, "mapped",
        lambda: stored(evaluate.map_targets(pairs(spark, folder), overlap(spark, folder)), "mapped", compression=SMALL),
    )


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint and doubles at six decimals, the form results are compared in."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            columns.append(F.col(field.name).cast("bigint").alias(field.name))
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            columns.append(F.round(F.col(field.name).cast("double"), 6).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


# The characters that strip() removes, for a regular expression that knows no Unicode \s.
SPACE = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}]"
)

RAW = f"""
raw AS (
  SELECT doc_id, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS text FROM documents
)"""

CORPUS = RAW + """,
kept AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, doc_id, text
  FROM raw WHERE length(text) >= 50
),
cut AS (
  SELECT CAST(round_even(CAST(count(*) AS DOUBLE) * 5 / 100, 0) AS BIGINT) AS n_val FROM kept
),
corpus AS (
  SELECT row_idx, doc_id, text,
         CASE WHEN row_idx < n_val THEN 'validation' ELSE 'train' END AS split,
         CASE WHEN row_idx < n_val THEN row_idx ELSE row_idx - n_val END AS split_idx
  FROM kept, cut
)"""


def _tokens(side: str, pattern: str) -> str:
    return f"""
{side}_word AS (
  SELECT row_idx, split, split_idx, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT *, regexp_extract_all(text, '{pattern}') AS w FROM corpus)
),
{side}_vocab AS (
  SELECT token, count(*) AS cnt,
         row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS token_id
  FROM {side}_word GROUP BY token
),
{side}_tok AS (
  SELECT row_idx, split, split_idx, pos, token_id
  FROM {side}_word JOIN {side}_vocab USING (token)
)"""


# The two built-in word tokenisers, as in functions/text.py.
SRC = _tokens("src", r"\S+")
TGT = _tokens("tgt", r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")
BOTH = f"{CORPUS},{SRC},{TGT}"

OVERLAP = """
overlap AS (
  SELECT t.token_id AS tgt_id, s.token_id AS src_id
  FROM tgt_vocab t JOIN src_vocab s USING (token)
)"""

PAIRS = """
src_len AS (SELECT row_idx, count(*) AS n FROM src_tok GROUP BY row_idx),
tgt_len AS (SELECT row_idx, count(*) AS n FROM tgt_tok GROUP BY row_idx),
samples AS (
  SELECT row_idx, split_idx AS sample_id
  FROM corpus JOIN src_len s USING (row_idx) JOIN tgt_len t USING (row_idx)
  WHERE split = 'validation' AND s.n >= 10 AND t.n >= 10
)"""

OCCURRENCES = """
occ AS (
  SELECT sample_id, pos, tgt_id, src_id
  FROM (SELECT sample_id, pos, token_id AS tgt_id FROM tgt_tok JOIN samples USING (row_idx))
  LEFT JOIN overlap USING (tgt_id)
)"""

EVAL = f"{BOTH},{OVERLAP},{PAIRS},{OCCURRENCES}"


def hash_long_sql(*parts: str) -> str:
    """SQL for functions.hashing.hash_long."""
    key = " || ':' || ".join(parts)
    return f"CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT)"
