"""Alignment queries.

The embeddings stand in for token vectors: the source vocabulary has them as they
are, the target vocabulary has them with the coordinates reversed, which is another
space with the same geometry.  Gold pairs are the rows of three of the labels.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vocabbridge.catalog.common import hash_long_sql, plain, stage, table
from vocabbridge.operators import align as A
from vocabbridge.plans import stages
from vocabbridge.storage import stored

PIVOTS = 40
GOLD_LABELS = 2
EXTRA_IDS = 64
TOP = 5


def _source(spark, folder):
    rows = table(spark, folder, "embeddings")
    return rows.select(
        F.col("vec_id").cast("string").alias("token"),
        F.col("vec_id").alias("ord"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def _target(spark, folder):
    return _source(spark, folder).withColumn("vector", F.reverse("vector"))


def _gold(spark, folder):
    rows = table(spark, folder, "embeddings").where(F.col("label") <= GOLD_LABELS)
    return rows.select(
        F.col("vec_id").cast("int").alias("tgt_id"), F.col("vec_id").cast("int").alias("src_id")
    )


def _usable(spark, folder):
    return A.usable_vectors(_target(spark, folder)), A.usable_vectors(_source(spark, folder))


def _pivots(spark, folder):
    def build():
        target, source = _usable(spark, folder)
        return stored(A.choose_pivots(_gold(spark, folder), target, source, PIVOTS), "pivots")

    return stage(spark, folder, "pivots", build)


def _relative(spark, folder):
    target, source = _usable(spark, folder)
    pivots = _pivots(spark, folder)
    return (
        A.relative_vectors(target, pivots, "tgt_id"),
        A.relative_vectors(source, pivots, "src_id"),
    )


def _size(spark, folder):
    return table(spark, folder, "embeddings").count()


def _matches(found):
    return plain(found.select("tgt_id", "src_id", "score"))


def pivots(spark, folder):
    target, source = _usable(spark, folder)
    return plain(A.choose_pivots(_gold(spark, folder), target, source, PIVOTS))


def relative_vectors(spark, folder):
    rep = _relative(spark, folder)[0]
    return plain(rep.select("id", F.posexplode("vector").alias("rank", "value")))


def relative_vectors_blocked(spark, folder):
    """The path for pivot matrices too large to broadcast."""
    target, _ = _usable(spark, folder)
    rep = A.relative_vectors(target, _pivots(spark, folder), "tgt_id", limit_bytes=0, block_rows=64)
    return plain(rep.select("id", F.posexplode("vector").alias("rank", "value")))


def nearest_vanilla(spark, folder):
    return _matches(A.nearest(*_usable(spark, folder), block_rows=256))


def nearest_relative(spark, folder):
    return _matches(A.nearest(*_relative(spark, folder)))


def nearest_relative_cosine(spark, folder):
    return _matches(A.nearest(*_relative(spark, folder), metric="cosine", block_rows=300))


def nearest_top_five(spark, folder):
    return plain(A.nearest(*_usable(spark, folder), k=TOP, block_rows=200))


def unknown_excluded(spark, folder):
    """The source rows of one label are named as the unknown token, so none may win."""
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("ord"), "label")
    named = _source(spark, folder).join(labels, "ord")
    unknown = F.when(F.col("label") == 0, "<unk>").when(F.col("label") == 1, "unk")
    source = named.select(F.coalesce(unknown, "token").alias("token"), "ord", "vector")
    return _matches(A.nearest(_usable(spark, folder)[0], A.usable_vectors(source)))


def ids_without_vector(spark, folder):
    target, _ = _usable(spark, folder)
    n = _size(spark, folder) + EXTRA_IDS
    found = A.without_vector(n, _gold(spark, folder), target, spark)
    return plain(
        found.select("tgt_id", A.random_source(F.col("tgt_id"), _size(spark, folder)).alias("src_id"))
    )


def _aligned(spark, folder, relative):
    n = _size(spark, folder)
    return stages.align_vocabularies(
        _gold(spark, folder), _target(spark, folder), _source(spark, folder),
        n + EXTRA_IDS, n, PIVOTS, relative,
    )


def alignment_vanilla(spark, folder):
    return plain(_aligned(spark, folder, relative=False))


def alignment_relative(spark, folder):
    return plain(_aligned(spark, folder, relative=True))


def origin_counts(spark, folder):
    return A.origin_counts(_aligned(spark, folder, relative=True))


def loaded_vectors(spark, folder):
    return A.usable_vectors(_source(spark, folder)).agg(F.count(F.lit(1)).alias("n_vectors"))


QUERIES = {
    f.__name__: f
    for f in (
        pivots, relative_vectors, relative_vectors_blocked, nearest_vanilla, nearest_relative,
        nearest_relative_cosine, nearest_top_five, unknown_excluded, ids_without_vector,
        alignment_vanilla, alignment_relative, origin_counts, loaded_vectors,
    )
}

_V = f"""vec AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
),
src AS (SELECT id, label, [x / sqrt(list_dot_product(e, e)) for x in e] AS v FROM vec),
tgt AS (SELECT id, list_reverse(v) AS v FROM src),
gold AS (SELECT id AS tgt_id, id AS src_id FROM src WHERE label <= {GOLD_LABELS}),
pivots AS (
  SELECT row_number() OVER (ORDER BY md5('0:' || tgt_id), tgt_id) - 1 AS rank, tgt_id, src_id
  FROM gold QUALIFY rank < {PIVOTS}
),
rel_parts AS (
  SELECT 't' AS side, t.id, p.rank, list_dot_product(t.v, q.v) AS value
  FROM tgt t, pivots p JOIN tgt q ON q.id = p.tgt_id
  UNION ALL
  SELECT 's', s.id, p.rank, list_dot_product(s.v, q.v)
  FROM src s, pivots p JOIN src q ON q.id = p.src_id
),
rel AS (SELECT side, id, list(value ORDER BY rank) AS v FROM rel_parts GROUP BY side, id),
rel_tgt AS (SELECT id, v FROM rel WHERE side = 't'),
rel_src AS (SELECT id, v FROM rel WHERE side = 's')"""


def _nearest_sql(tgt: str, src: str, k: int = 1, score: str = "list_dot_product(t.v, s.v)", where: str = "true") -> str:
    return f"""best AS (
      SELECT t.id AS tgt_id, s.id AS src_id, round({score}, 12) AS exact,
        row_number() OVER (PARTITION BY t.id ORDER BY round({score}, 12) DESC, s.id) AS rank
      FROM {tgt} t, {src} s WHERE {where}
      QUALIFY rank <= {k}
    )"""


_RANDOM = f"{hash_long_sql(chr(39) + '0' + chr(39), 'tgt_id')} % (SELECT count(*) FROM embeddings)"
_RESOLVED = f"""resolved AS (
  SELECT tgt_id, coalesce(g.src_id, b.src_id, {_RANDOM}) AS src_id,
    CASE WHEN g.src_id IS NOT NULL THEN 'gold' WHEN b.src_id IS NOT NULL THEN 'vector' ELSE 'random' END AS origin
  FROM (SELECT range AS tgt_id FROM range((SELECT count(*) + {EXTRA_IDS} FROM embeddings)))
  LEFT JOIN gold g USING (tgt_id) LEFT JOIN best b USING (tgt_id)
)"""
_BEST = "SELECT tgt_id, src_id, round(exact, 6) AS score FROM best"

SQL = {
    "pivots": f"WITH {_V} SELECT rank, tgt_id, src_id FROM pivots",
    "relative_vectors": f"WITH {_V} SELECT id, rank, round(value, 6) AS value FROM rel_parts WHERE side = 't'",
    "relative_vectors_blocked": f"WITH {_V} SELECT id, rank, round(value, 6) AS value FROM rel_parts WHERE side = 't'",
    "nearest_vanilla": f"WITH {_V},{_nearest_sql('tgt', 'src')} {_BEST}",
    "nearest_relative": f"WITH {_V},{_nearest_sql('rel_tgt', 'rel_src')} {_BEST}",
    "nearest_relative_cosine": f"WITH {_V},{_nearest_sql('rel_tgt', 'rel_src', 1, 'list_cosine_similarity(t.v, s.v)')} {_BEST}",
    "nearest_top_five": f"""WITH {_V},{_nearest_sql('tgt', 'src', TOP)}
        SELECT tgt_id, src_id, round(exact, 6) AS score, rank FROM best""",
    "unknown_excluded": f"WITH {_V},{_nearest_sql('tgt', 'src', 1, where='s.label NOT IN (0, 1)')} {_BEST}",
    "ids_without_vector": f"""WITH {_V}
        SELECT tgt_id, {_RANDOM} AS src_id
        FROM (SELECT range AS tgt_id FROM range((SELECT count(*) + {EXTRA_IDS} FROM embeddings)))
        WHERE tgt_id NOT IN (SELECT tgt_id FROM gold) AND tgt_id NOT IN (SELECT id FROM tgt)""",
    "alignment_vanilla": f"WITH {_V},{_nearest_sql('tgt', 'src')},{_RESOLVED} SELECT * FROM resolved",
    "alignment_relative": f"WITH {_V},{_nearest_sql('rel_tgt', 'rel_src')},{_RESOLVED} SELECT * FROM resolved",
    "origin_counts": f"""WITH {_V},{_nearest_sql('rel_tgt', 'rel_src')},{_RESOLVED}
        SELECT origin, count(*) AS n_ids FROM resolved GROUP BY origin""",
    "loaded_vectors": "SELECT count(*) AS n_vectors FROM embeddings",
}
