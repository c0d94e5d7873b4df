"""Co-occurrence and vector-fit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocabbridge.catalog.common import (
    CORPUS, SRC, TGT, hash_long_sql, plain, source, stage, table, target,
)
from vocabbridge.functions.vectors import l2_normalise
from vocabbridge.operators import cooccur as C
from vocabbridge.operators import glove as G
from vocabbridge.plans import stages
from vocabbridge.storage import stored

WINDOW = 5
DIMS = 4
# The fit that is replayed in SQL.
PASSES, BLOCKS, RATE = 3, 3, G.STRATA_RATE


def _train(side):
    return side.rows.where(F.col("split") == "train").select("row_idx", "input_ids")


def _cooc(spark, folder):
    return stage(
        spark, folder, "cooc",
        lambda: stored(stages.count_packed(target(spark, folder), WINDOW), "cooc"),
    )


def _ids(spark, folder):
    return stages.vector_vocabulary(target(spark, folder).vocab)


def vocabulary_positions(spark, folder):
    """Positions over in-vocabulary tokens only."""
    side = source(spark, folder)
    kept = C.in_vocabulary(_train(side), stages.vector_vocabulary(side.vocab))
    return plain(kept.select("row_idx", F.posexplode("ids").alias("pos", "vec_id")))


def cooccurrence(spark, folder):
    return plain(stages.count_pairs(target(spark, folder), WINDOW))


def cooccurrence_raw_distance(spark, folder):
    side = target(spark, folder)
    ids = C.in_vocabulary(_train(side), stages.vector_vocabulary(side.vocab), "raw")
    return plain(C.cooccurrence(ids, WINDOW))


def cooccurrence_totals(spark, folder):
    """Totals at the full window, the weight at three decimals: a sum of millions of terms."""
    totals = C.matrix_totals(stages.count_packed(source(spark, folder), C.WINDOW))
    return totals.select("n_pairs", F.round("weight", 3).alias("weight"))


def initial_parameters(spark, folder):
    start = G.initial_parameters(_ids(spark, folder), DIMS)
    return plain(start.select("side", "id", F.posexplode("value").alias("d", "value")))


def fit_loss(spark, folder):
    ids = _ids(spark, folder)
    params = stored(G.initial_parameters(ids, DIMS), "parameters")
    cooc = _cooc(spark, folder)
    blocks = G.split_count(1, ids.count(), C.pair_count(cooc), DIMS, spark.sparkContext.defaultParallelism)
    partial = G.gradients(G.blocked(cooc, blocks), params, blocks)
    return G.loss(partial).select(F.round("loss", 3).alias("loss"))


def fit_one_pass(spark, folder):
    params = G.fit(_cooc(spark, folder), _ids(spark, folder), DIMS, passes=1, rate=0.05, block_pairs=100_000, schedule="batch")
    return plain(params.select("side", "id", F.posexplode("value").alias("d", "value")))


def final_vectors(spark, folder):
    vectors = G.final_vectors(G.initial_parameters(_ids(spark, folder), DIMS))
    return plain(vectors.select("id", F.posexplode("vector").alias("d", "value")))


def _fitted(spark, folder):
    """Parameters after three passes over three blocks, and the loss of each pass."""

    def build():
        losses = []
        params = G.fit(
            _cooc(spark, folder), _ids(spark, folder), DIMS, PASSES, rate=RATE, min_blocks=BLOCKS,
            block_ids=1 << 40, block_pairs=1 << 40,
            on_pass=lambda number, p: losses.append((number, p.agg(F.sum("loss")).first()[0])),
        )
        return params, losses

    return stage(spark, folder, "fitted", build)


def fitted_vectors(spark, folder):
    """The vectors of three passes, component by component."""
    params, _ = _fitted(spark, folder)
    vectors = G.token_vectors(params, _ids(spark, folder))
    cells = vectors.select("token", "ord", F.posexplode("vector").alias("d", "value"))
    return plain(cells.withColumn("value", F.round("value", 5)))


def fit_losses(spark, folder):
    """The objective over three passes."""
    _, losses = _fitted(spark, folder)
    rows = spark.createDataFrame(losses, "pass long, loss double")
    return rows.select("pass", F.round("loss", 3).alias("loss"))


def normalised_vectors(spark, folder):
    rows = table(spark, folder, "embeddings")
    unit = rows.select("vec_id", F.posexplode(l2_normalise(F.col("embedding"))).alias("d", "value"))
    return plain(unit)


QUERIES = {
    f.__name__: f
    for f in (
        vocabulary_positions, cooccurrence, cooccurrence_raw_distance, cooccurrence_totals,
        initial_parameters, fit_loss, fit_one_pass, final_vectors, fitted_vectors, fit_losses, normalised_vectors,
    )
}


def _cooc_sql(side: str, window: int, raw: bool = False) -> str:
    place = "pos" if raw else "row_number() OVER (PARTITION BY row_idx ORDER BY pos)"
    return f"""kept_tok AS (
      SELECT row_idx, {place} AS p, token_id
      FROM {side}_tok JOIN {side}_vocab v USING (token_id) WHERE split = 'train' AND v.cnt >= 5
    ),
    near AS (
      SELECT a.token_id AS i, b.token_id AS j, CAST(1 AS DOUBLE) / a.d AS w
      FROM (SELECT *, unnest(range(1, {window + 1})) AS d FROM kept_tok) a
      JOIN kept_tok b ON b.row_idx = a.row_idx AND b.p = a.p + a.d
    ),
    cooc AS (
      SELECT i, j, sum(w) AS x
      FROM (SELECT i, j, w FROM near UNION ALL SELECT j, i, w FROM near) GROUP BY i, j
    )"""


_UNIFORM = f"{hash_long_sql(chr(39) + '0' + chr(39), 'side', 'id', 'd')} / 1152921504606846976.0::DOUBLE"
_PARAMS = f"""params AS (
  SELECT side, id, d, ({_UNIFORM} - 0.5) / {DIMS} AS v
  FROM (SELECT token_id AS id FROM tgt_vocab WHERE cnt >= 5),
    (VALUES ('w'), ('c')) s(side), range({DIMS + 1}) r(d)
)"""
_ERRORS = f"""lists AS (SELECT side, id, list(v ORDER BY d) AS v FROM params GROUP BY side, id),
errors AS (
  SELECT i, j, least(1, pow(x / 10, 0.75)) AS f,
    list_dot_product(w.v[1:{DIMS}], c.v[1:{DIMS}]) + w.v[{DIMS + 1}] + c.v[{DIMS + 1}] - ln(x) AS miss
  FROM cooc JOIN lists w ON w.side = 'w' AND w.id = i JOIN lists c ON c.side = 'c' AND c.id = j
)"""


def _replay() -> str:
    """Every step of the fit: errors and slopes of a stratum, then the parameters after it."""
    steps = [f"""p0 AS MATERIALIZED (SELECT side, id, d, v, CAST(1 AS DOUBLE) AS q FROM params)"""]
    for n in range(PASSES * BLOCKS):
        steps.append(f"""l{n} AS MATERIALIZED (SELECT side, id, list(v ORDER BY d) AS v FROM p{n} GROUP BY side, id),
        e{n} AS MATERIALIZED (
          SELECT i, j, least(1, pow(x / 10, 0.75)) AS f, w.v AS wv, c.v AS cv,
            list_dot_product(w.v[1:{DIMS}], c.v[1:{DIMS}]) + w.v[{DIMS + 1}] + c.v[{DIMS + 1}] - ln(x) AS miss
          FROM cooc JOIN l{n} w ON w.side = 'w' AND w.id = i JOIN l{n} c ON c.side = 'c' AND c.id = j
          WHERE (i % {BLOCKS} + {n % BLOCKS}) % {BLOCKS} = j % {BLOCKS}
        ),
        g{n} AS MATERIALIZED (
          SELECT 'w' AS side, i AS id, d, sum(f * miss * CASE WHEN d = {DIMS} THEN 1 ELSE cv[d + 1] END) AS g
          FROM e{n}, range({DIMS + 1}) r(d) GROUP BY i, d
          UNION ALL
          SELECT 'c', j, d, sum(f * miss * CASE WHEN d = {DIMS} THEN 1 ELSE wv[d + 1] END)
          FROM e{n}, range({DIMS + 1}) r(d) GROUP BY j, d
        ),
        p{n + 1} AS MATERIALIZED (
          SELECT side, id, d, v - {RATE} * coalesce(g, 0) / sqrt(q + coalesce(g, 0) * coalesce(g, 0)) AS v,
            q + coalesce(g, 0) * coalesce(g, 0) AS q
          FROM p{n} LEFT JOIN g{n} USING (side, id, d)
        )""")
    return ", ".join(steps)


_G = f"WITH {CORPUS},{TGT},{_cooc_sql('tgt', WINDOW)}"

SQL = {
    "vocabulary_positions": f"""WITH {CORPUS},{SRC},{_cooc_sql('src', WINDOW)}
        SELECT row_idx, p - 1 AS pos, token_id AS vec_id FROM kept_tok""",
    "cooccurrence": f"{_G} SELECT i, j, round(x, 6) AS x FROM cooc",
    "cooccurrence_raw_distance": f"""WITH {CORPUS},{TGT},{_cooc_sql('tgt', WINDOW, raw=True)}
        SELECT i, j, round(x, 6) AS x FROM cooc""",
    "cooccurrence_totals": f"""WITH {CORPUS},{SRC},{_cooc_sql('src', 15)}
        SELECT count(*) AS n_pairs, round(sum(x), 3) AS weight FROM cooc""",
    "initial_parameters": f"WITH {CORPUS},{TGT},{_PARAMS} SELECT side, id, d, round(v, 6) AS value FROM params",
    "fit_loss": f"{_G},{_PARAMS},{_ERRORS} SELECT round(sum(f * miss * miss), 3) AS loss FROM errors",
    "fit_one_pass": f"""{_G},{_PARAMS},{_ERRORS},
        slopes AS (
          SELECT 'w' AS side, i AS id, d, sum(f * miss * CASE WHEN d = {DIMS} THEN 1 ELSE v END) AS g
          FROM errors JOIN params p ON p.side = 'c' AND p.id = j GROUP BY i, d
          UNION ALL
          SELECT 'c', j, d, sum(f * miss * CASE WHEN d = {DIMS} THEN 1 ELSE v END)
          FROM errors JOIN params p ON p.side = 'w' AND p.id = i GROUP BY j, d
        )
        SELECT side, id, d, round(v - 0.05 * coalesce(g, 0) / sqrt(1 + coalesce(g, 0) * coalesce(g, 0)), 6) AS value
        FROM params LEFT JOIN slopes USING (side, id, d)""",
    "final_vectors": f"""WITH {CORPUS},{TGT},{_PARAMS}
        SELECT id, d, round(sum(v), 6) AS value FROM params WHERE d < {DIMS} GROUP BY id, d""",
    "fitted_vectors": f"""{_G},{_PARAMS},{_replay()}
        SELECT CAST(id AS VARCHAR) AS token, id AS ord, d, round(sum(v), 5) AS value
        FROM p{PASSES * BLOCKS} WHERE d < {DIMS} GROUP BY id, d""",
    "fit_losses": f"""{_G},{_PARAMS},{_replay()}
        {" UNION ALL ".join(f"""SELECT {number}::BIGINT AS pass, round(sum(part), 3) AS loss FROM (
          {" UNION ALL ".join(f"SELECT sum(f * miss * miss) AS part FROM e{number * BLOCKS + t}" for t in range(BLOCKS))})"""
          for number in range(PASSES))}""",
    "normalised_vectors": """WITH v AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
        SELECT vec_id, unnest(range(len(e))) AS d,
          round(unnest(e) / sqrt(list_dot_product(e, e)), 6) AS value FROM v""",
}
