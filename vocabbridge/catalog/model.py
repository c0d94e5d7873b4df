"""Embedding-table queries.

The embeddings stand in for a model: ``embed`` has them as they are, ``lm_head``
negated.  The alignment maps target ids onto the table through a hash, so some rows
are taken often and some never.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vocabbridge.catalog.common import hash_long_sql, plain, table
from vocabbridge.operators import rearrange as M

DIMS = 64
EXTRA = 200
SHARE = 0.3
SHRINK = 100


def _model(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("token_id"), F.col("embedding").alias("vector")
    )
    negated = F.transform("vector", lambda x: -x)
    return rows.withColumn("matrix", F.lit("embed")).unionByName(
        rows.select("token_id", negated.alias("vector")).withColumn("matrix", F.lit("lm_head"))
    )


def _alignment(spark, folder):
    """Every target id below the table size plus ``EXTRA``; a third of them share one source row."""
    size = table(spark, folder, "embeddings").count()
    drawn = M.random_alignment(spark, size + EXTRA, size, "map")
    hot = F.col("tgt_id") * 3 < size + EXTRA
    return drawn.withColumn("src_id", F.when(hot, F.lit(5)).otherwise(F.col("src_id")))


def _cells(model):
    return plain(model.select("matrix", "token_id", F.posexplode("vector").alias("d", "value")))


def rearranged_rows(spark, folder):
    alignment = _alignment(spark, folder)
    M.check_complete(alignment)
    return _cells(M.gather(alignment, _model(spark, folder)))


def rearranged_rows_salted(spark, folder):
    """The path for tables too large to broadcast."""
    return _cells(M.gather(_alignment(spark, folder), _model(spark, folder), limit_bytes=0))


def rearranged_perturbed(spark, folder):
    size = table(spark, folder, "embeddings").count()
    return _cells(M.gather(M.perturb(_alignment(spark, folder), SHARE, size), _model(spark, folder)))


def rearranged_random(spark, folder):
    size = table(spark, folder, "embeddings").count()
    drawn = M.random_alignment(spark, size + EXTRA, size)
    return _cells(M.gather(drawn, _model(spark, folder)))


def fresh_rows(spark, folder):
    size = table(spark, folder, "embeddings").count()
    return _cells(M.all_new(_model(spark, folder), size + EXTRA, DIMS))


def extended_rows(spark, folder):
    size = table(spark, folder, "embeddings").count()
    return _cells(M.keep_prefix(_model(spark, folder), size + EXTRA, DIMS))


def truncated_rows(spark, folder):
    size = table(spark, folder, "embeddings").count()
    return _cells(M.keep_prefix(_model(spark, folder), size - SHRINK, DIMS))


def matrix_shapes(spark, folder):
    return plain(M.matrix_shapes(_model(spark, folder)))


def equal_row_counts(spark, folder):
    return plain(M.same_rows(_model(spark, folder)))


QUERIES = {
    f.__name__: f
    for f in (
        rearranged_rows, rearranged_rows_salted, rearranged_perturbed, rearranged_random, fresh_rows,
        extended_rows, truncated_rows, matrix_shapes, equal_row_counts,
    )
}

_N = "(SELECT count(*) FROM embeddings)"


def _hash(*parts: str) -> str:
    return hash_long_sql(*parts)


_M = f"""model AS (
  SELECT 'embed' AS matrix, vec_id AS token_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  UNION ALL
  SELECT 'lm_head', vec_id, [-x for x in CAST(embedding AS DOUBLE[])] FROM embeddings
),
ids AS (SELECT range AS tgt_id FROM range({_N} + {EXTRA})),
alignment AS (
  SELECT tgt_id, CASE WHEN tgt_id * 3 < {_N} + {EXTRA} THEN 5
    ELSE {_hash("'map'", 'tgt_id')} % {_N} END AS src_id FROM ids
),
perturbed AS (
  SELECT tgt_id, CASE WHEN {_hash("'0:hit'", 'tgt_id')} / 1152921504606846976.0::DOUBLE < {SHARE}
    THEN {_hash("'0:pick'", 'tgt_id')} % {_N} ELSE src_id END AS src_id FROM alignment
),
drawn AS (SELECT tgt_id, {_hash("'0'", 'tgt_id')} % {_N} AS src_id FROM ids),
fresh AS (
  SELECT matrix, tgt_id AS token_id, d,
    round(CAST(0.02 * sqrt(-2 * ln(1 - {_hash("'0:r'", 'matrix', 'tgt_id', 'd')} / 1152921504606846976.0::DOUBLE))
      * cos(2 * pi() * {_hash("'0:a'", 'matrix', 'tgt_id', 'd')} / 1152921504606846976.0::DOUBLE) AS FLOAT)::DOUBLE, 6) AS value
  FROM ids, (VALUES ('embed'), ('lm_head')) m(matrix), range({DIMS}) r(d)
),
cells AS (SELECT matrix, token_id, unnest(range(len(v))) AS d, round(unnest(v), 6) AS value FROM model)"""


def _gather_sql(mapping: str) -> str:
    return f"""WITH {_M} SELECT matrix, tgt_id AS token_id, d, value
      FROM {mapping} JOIN cells ON src_id = token_id"""


SQL = {
    "rearranged_rows": _gather_sql("alignment"),
    "rearranged_rows_salted": _gather_sql("alignment"),
    "rearranged_perturbed": _gather_sql("perturbed"),
    "rearranged_random": _gather_sql("drawn"),
    "fresh_rows": f"WITH {_M} SELECT matrix, token_id, d, value FROM fresh",
    "extended_rows": f"""WITH {_M} SELECT matrix, token_id, d, value FROM cells
        UNION ALL SELECT matrix, token_id, d, value FROM fresh WHERE token_id >= {_N}""",
    "truncated_rows": f"WITH {_M} SELECT matrix, token_id, d, value FROM cells WHERE token_id < {_N} - {SHRINK}",
    "matrix_shapes": f"WITH {_M} SELECT matrix, count(*) AS n_rows, max(len(v)) AS dims FROM model GROUP BY matrix",
    "equal_row_counts": f"SELECT {_N} AS min_rows, {_N} AS max_rows, true AS equal",
}
