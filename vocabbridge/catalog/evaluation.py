"""Queries that score an alignment on the held-out pairs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vocabbridge.catalog.common import (
    BOTH, EVAL, OVERLAP, PAIRS, mapped, overlap, pairs, plain, source, target, table,
)
from vocabbridge.functions.sequences import ids_to_line
from vocabbridge.operators import evaluate as E
from vocabbridge.plans import stages

BLEU4 = (0.25, 0.25, 0.25, 0.25)


def mapped_targets(spark, folder):
    rows = E.map_targets(pairs(spark, folder), overlap(spark, folder))
    return plain(rows.select("sample_id", F.md5(ids_to_line(F.col("pred_ids"))).alias("pred_md5")))


def mapped_targets_joined(spark, folder):
    """The path for alignments too large to broadcast."""
    rows = E.map_targets(pairs(spark, folder), overlap(spark, folder), limit_bytes=0)
    return plain(rows.select("sample_id", F.md5(ids_to_line(F.col("pred_ids"))).alias("pred_md5")))


def mapped_targets_strict(spark, folder):
    """Strict mapping: every target id is aligned, to its own id plus one."""
    full = target(spark, folder).vocab.select(
        F.col("token_id").alias("tgt_id"), (F.col("token_id") + 1).alias("src_id")
    )
    rows = E.map_targets_strict(pairs(spark, folder), full)
    return plain(rows.select("sample_id", F.md5(ids_to_line(F.col("pred_ids"))).alias("pred_md5")))


def unmapped_ids(spark, folder):
    return plain(E.unmapped_ids(pairs(spark, folder), overlap(spark, folder)))


def sentence_bleu(spark, folder):
    return plain(E.sentence_bleu(mapped(spark, folder)))


def sentence_bleu_four(spark, folder):
    return plain(E.sentence_bleu(mapped(spark, folder), BLEU4))


def mean_bleu(spark, folder):
    return plain(E.mean_bleu(E.sentence_bleu(mapped(spark, folder))))


def unmapped_rate(spark, folder):
    return plain(E.unmapped_rate(E.occurrences(mapped(spark, folder))))


def mapping_histogram(spark, folder):
    histogram = E.source_histogram(E.occurrences(mapped(spark, folder)))
    return plain(
        histogram.select(
            "src_id", "cnt", "n_targets",
            F.col("first_seen.sample_id").alias("first_sample"), F.col("first_seen.pos").alias("first_pos"),
        )
    )


def mapping_summary(spark, folder):
    return plain(E.mapping_summary(E.source_histogram(E.occurrences(mapped(spark, folder)))))


def alignment_size(spark, folder):
    return overlap(spark, folder).agg(F.count(F.lit(1)).alias("n_entries"))


def top_sources(spark, folder):
    histogram = E.source_histogram(E.occurrences(mapped(spark, folder)))
    return plain(E.top_sources(histogram, source(spark, folder).vocab))


def sample_preview(spark, folder):
    return E.preview(mapped(spark, folder))


def mean_cosine(spark, folder):
    """Each embedding against its own reversal: two embeddings per sample."""
    rows = table(spark, folder, "embeddings").select(
        F.col("embedding").alias("a"), F.reverse("embedding").alias("b")
    )
    return plain(E.mean_cosine(rows))


def overlap_score(spark, folder):
    return plain(stages.score(pairs(spark, folder), overlap(spark, folder)))


QUERIES = {
    f.__name__: f
    for f in (
        mapped_targets, mapped_targets_joined, mapped_targets_strict, unmapped_ids, sentence_bleu, sentence_bleu_four,
        mean_bleu, unmapped_rate, mapping_histogram, mapping_summary, alignment_size, top_sources,
        sample_preview, mean_cosine, overlap_score,
    )
}


def bleu_sql(weights: tuple[float, ...]) -> str:
    """Sentence BLEU from ordered id lists of both sides."""
    orders = [n for n, w in enumerate(weights, 1) if n == 1 or w]
    grams = " UNION ALL ".join(
        f"""SELECT sample_id, {n} AS n, side, array_to_string(list_slice(ids, i, i + {n - 1}), ' ') AS gram
        FROM (SELECT sample_id, side, ids, unnest(range(1, len(ids) - {n} + 2)) AS i FROM seqs)"""
        for n in orders
    )
    logs = " + ".join(
        f"""{weights[n - 1]} * ln(CASE WHEN max(hits) FILTER (n = {n}) > 0
          THEN max(hits) FILTER (n = {n}) / greatest(max(n_pred) FILTER (n = {n}), 1)
          ELSE 2.2250738585072014e-308 END)"""
        for n in orders
    )
    return f"""seqs AS (
      SELECT sample_id, 'p' AS side, list(coalesce(src_id, -1) ORDER BY pos) AS ids FROM occ GROUP BY sample_id
      UNION ALL
      SELECT sample_id, 'r', list(token_id ORDER BY pos) FROM src_tok JOIN samples USING (row_idx) GROUP BY sample_id
    ),
    grams AS ({grams}),
    counted AS (
      SELECT sample_id, n, gram, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r
      FROM grams GROUP BY ALL
    ),
    per_order AS (
      SELECT sample_id, n, CAST(sum(least(p, r)) AS DOUBLE) AS hits,
        CAST(sum(p) AS DOUBLE) AS n_pred, CAST(sum(r) AS DOUBLE) AS n_ref
      FROM counted GROUP BY sample_id, n
    ),
    bleu AS (
      SELECT sample_id, CASE WHEN max(hits) FILTER (n = 1) = 0 THEN 0 ELSE
        (CASE WHEN max(n_pred) FILTER (n = 1) > max(n_ref) FILTER (n = 1) THEN 1
          ELSE exp(1 - max(n_ref) FILTER (n = 1) / max(n_pred) FILTER (n = 1)) END)
        * exp({logs}) END AS bleu
      FROM per_order GROUP BY sample_id
    )"""


_PRED = """SELECT sample_id, md5(string_agg(CAST({id} AS VARCHAR), ' ' ORDER BY pos)) AS pred_md5
  FROM occ GROUP BY sample_id"""
_HIST = """hist AS (
  SELECT src_id, count(*) AS cnt, count(DISTINCT tgt_id) AS n_targets, min((sample_id, pos)) AS seen
  FROM occ WHERE src_id IS NOT NULL GROUP BY src_id
)"""
# Each step computed once: the query reads most of them several times.
_STORED = re.sub(r"(\w+) AS \(\n?", r"\1 AS MATERIALIZED (", EVAL)

SQL = {
    "mapped_targets": f"WITH {EVAL} {_PRED.format(id='coalesce(src_id, -1)')}",
    "mapped_targets_joined": f"WITH {EVAL} {_PRED.format(id='coalesce(src_id, -1)')}",
    "mapped_targets_strict": f"WITH {EVAL} {_PRED.format(id='tgt_id + 1')}",
    "unmapped_ids": f"WITH {EVAL} SELECT tgt_id, count(*) AS cnt FROM occ WHERE src_id IS NULL GROUP BY tgt_id",
    "sentence_bleu": f"WITH {EVAL},{bleu_sql((1.0, 0, 0, 0))} SELECT sample_id, round(bleu, 6) AS bleu FROM bleu",
    "sentence_bleu_four": f"WITH {EVAL},{bleu_sql(BLEU4)} SELECT sample_id, round(bleu, 6) AS bleu FROM bleu",
    "mean_bleu": f"""WITH {EVAL},{bleu_sql((1.0, 0, 0, 0))}
        SELECT round(avg(bleu), 6) AS mean_bleu, count(*) AS n_samples FROM bleu""",
    "unmapped_rate": f"""WITH {EVAL} SELECT count(*) AS n_tokens, count(*) - count(src_id) AS n_unmapped,
        round((count(*) - count(src_id)) * 100.0 / greatest(count(*), 1), 6) AS percent FROM occ""",
    "mapping_histogram": f"""WITH {EVAL},{_HIST} SELECT src_id, cnt, n_targets,
        seen[1] AS first_sample, seen[2] AS first_pos FROM hist""",
    "mapping_summary": f"""WITH {EVAL},{_HIST} SELECT count(*) AS n_sources, CAST(sum(cnt) AS BIGINT) AS n_mapped,
        round(sum(cnt) / greatest(count(*), 1), 6) AS mean_per_source FROM hist""",
    "alignment_size": f"WITH {BOTH},{OVERLAP} SELECT count(*) AS n_entries FROM overlap",
    "top_sources": f"""WITH {_STORED},{_HIST.replace("hist AS (", "hist AS MATERIALIZED (")},
        top AS (SELECT * FROM hist ORDER BY cnt DESC, seen LIMIT 10)
        SELECT src_id, token, top.cnt AS cnt, round(top.cnt * 100.0 / (SELECT sum(cnt) FROM hist), 6) AS percent,
          n_targets FROM top JOIN src_vocab ON src_id = token_id""",
    "sample_preview": f"""WITH {EVAL} SELECT sample_id,
        (SELECT string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY pos) FROM src_tok s
          WHERE s.row_idx = m.row_idx AND pos < 10) AS src_head,
        string_agg(CAST(tgt_id AS VARCHAR), ' ' ORDER BY pos) AS tgt_head,
        string_agg(coalesce(CAST(src_id AS VARCHAR), '<UNK>'), ' ' ORDER BY pos) AS pred_head
        FROM occ JOIN samples m USING (sample_id) WHERE sample_id < 3 AND pos < 10
        GROUP BY sample_id, m.row_idx""",
    "mean_cosine": """WITH v AS (SELECT CAST(embedding AS DOUBLE[]) AS a,
          list_reverse(CAST(embedding AS DOUBLE[])) AS b FROM embeddings)
        SELECT round(avg(list_cosine_similarity(a, b)), 6) AS mean_cosine, count(*) AS n_samples FROM v""",
    "overlap_score": f"""WITH {EVAL},{bleu_sql((1.0, 0, 0, 0))}
        SELECT round(avg(bleu), 6) AS mean_bleu, count(*) AS n_samples,
          (SELECT count(*) FROM occ) AS n_tokens,
          (SELECT count(*) - count(src_id) FROM occ) AS n_unmapped,
          (SELECT round((count(*) - count(src_id)) * 100.0 / count(*), 6) FROM occ) AS percent_unmapped
        FROM bleu""",
}
