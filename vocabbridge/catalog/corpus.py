"""Corpus preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocabbridge.catalog.common import BOTH, CORPUS, RAW, SPACE, SRC, plain, prepared, source, stage, table
from vocabbridge.functions.text import WORDS, text_to_json, words
from vocabbridge.operators import corpus as C
from vocabbridge.operators import rowindex as R
from vocabbridge.plans import stages
from vocabbridge.storage import stored

# Batches of 50 raw rows and a budget that cuts the corpus in the middle of its batches.
BATCH, BUDGET = 50, 50_000


def _documents(spark, folder):
    return table(spark, folder, "documents")


def _marked(spark, folder):
    """Raw rows with their index, fate and token count."""

    def build():
        marked = C.mark_rows(_documents(spark, folder).select("doc_id", "text"))
        n_tokens = F.when(F.col("fate") == "kept", F.size(words(F.col("text"), WORDS)))
        indexed = R.with_row_index(marked, "doc_id")
        return stored(indexed.select("row_idx", "fate", n_tokens.alias("n_tokens")), "marked")

    return stage(spark, folder, "marked", build)


def strip_and_filter(spark, folder):
    kept = C.keep_rows(_documents(spark, folder))
    return plain(kept.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("text_md5")))


def row_fates(spark, folder):
    marked = C.mark_rows(_documents(spark, folder))
    return marked.groupBy("fate").agg(F.count(F.lit(1)).alias("n_rows"))


def row_index(spark, folder):
    kept = C.keep_rows(_documents(spark, folder).select("doc_id", "text"))
    return R.with_row_index(kept, "doc_id").select("row_idx", "doc_id")


def row_index_composite(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn")
    return R.with_row_index(turns, F.desc("conv_id"), F.asc("turn"))


def row_batches(spark, folder):
    batched = R.with_batch(prepared(spark, folder), 1000)
    return batched.groupBy("batch").agg(
        F.min("row_idx").alias("first_row"), F.count(F.lit(1)).alias("n_rows")
    )


def batch_running_totals(spark, folder):
    return plain(C.batch_totals(_marked(spark, folder), BATCH))


def token_budget_cut(spark, folder):
    rows = C.within_budget(_marked(spark, folder), BUDGET, BATCH)
    return plain(rows.select("row_idx", "batch", "fate"))


def prepared_budget(spark, folder):
    """The prepared corpus of a token budget."""
    rows = stages.prepare(_documents(spark, folder), token_budget=BUDGET, batch_rows=BATCH)
    return plain(rows.select("doc_id", "row_idx", "split", "split_idx"))


def prepared_validation(spark, folder):
    """The prepared corpus with a validation table of its own: texts of the benchmark."""
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    rows = stages.prepare(_documents(spark, folder), validation=items)
    return plain(rows.select("doc_id", "row_idx", "split", "split_idx", F.md5("text").alias("text_md5")))


def corpus_statistics(spark, folder):
    return plain(C.corpus_statistics(C.within_budget(_marked(spark, folder), BUDGET, BATCH)))


def corpus_statistics_all(spark, folder):
    return plain(C.corpus_statistics(_marked(spark, folder)))


def head_split(spark, folder):
    kept = C.keep_rows(_documents(spark, folder).select("doc_id", "text"))
    split = C.head_split(R.with_row_index(kept, "doc_id"))
    return split.select("doc_id", "row_idx", "split", "split_idx")


def split_sizes(spark, folder):
    return C.split_sizes(prepared(spark, folder))


def chars_per_token(spark, folder):
    rows = prepared(spark, folder).select(
        "row_idx", "text", F.size(words(F.col("text"), WORDS)).alias("n_tokens")
    )
    return plain(C.chars_per_token(rows))


def row_json(spark, folder):
    kept = C.keep_rows(_documents(spark, folder))
    return kept.select("doc_id", F.md5(text_to_json(F.col("text"))).alias("json_md5"))


def dataset_counts(spark, folder):
    raw = _documents(spark, folder)
    n = F.count(F.lit(1))
    return raw.agg(n.alias("n_rows"), F.ceil(n / 1000).alias("n_batches"))


def feed_rotation(spark, folder):
    return R.rotate(prepared(spark, folder).select("row_idx", "doc_id"), 137)


def strided_shards(spark, folder):
    rows = prepared(spark, folder).select("row_idx", "doc_id")
    workers = 3
    shards = [R.strided_shard(rows, w, workers).withColumn("worker", F.lit(w)) for w in range(workers)]
    return plain(shards[0].unionByName(shards[1]).unionByName(shards[2]))


def repeated_feed(spark, folder):
    rows = prepared(spark, folder).select("row_idx", "doc_id")
    return plain(R.repeat(rows, 3))


def head_rows(spark, folder):
    return R.head_rows(prepared(spark, folder).select("row_idx", "doc_id"), 400)


QUERIES = {
    f.__name__: f
    for f in (
        strip_and_filter, row_fates, row_index, row_index_composite, row_batches,
        batch_running_totals, token_budget_cut, prepared_budget, prepared_validation,
        corpus_statistics, corpus_statistics_all,
        head_split, split_sizes, chars_per_token, row_json, dataset_counts, feed_rotation,
        strided_shards, repeated_feed, head_rows,
    )
}

_MARKED = RAW + r""",
marked AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx,
         CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 50 THEN 'short' ELSE 'kept' END AS fate,
         CASE WHEN length(text) >= 50 THEN len(regexp_extract_all(text, '\S+')) ELSE 0 END AS n_tokens
  FROM raw
),
totals AS (
  SELECT row_idx // 50 AS batch,
         count(*) FILTER (fate = 'kept') AS kept,
         count(*) FILTER (fate = 'empty') AS skipped_empty,
         count(*) FILTER (fate = 'short') AS skipped_short,
         CAST(sum(n_tokens) AS BIGINT) AS tokens
  FROM marked GROUP BY 1
),
running AS (
  SELECT *, CAST(coalesce(sum(tokens) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tokens_before
  FROM totals
),
taken AS (
  SELECT row_idx, batch, fate, n_tokens
  FROM marked JOIN running ON row_idx // 50 = batch
  WHERE batch = 0 OR tokens_before < 50000
)"""
_STATS = """SELECT count(*) FILTER (fate = 'kept') AS kept, CAST(sum(n_tokens) AS BIGINT) AS tokens,
  count(*) FILTER (fate = 'empty') AS skipped_empty, count(*) FILTER (fate = 'short') AS skipped_short"""

SQL = {
    "strip_and_filter": f"WITH {CORPUS} SELECT doc_id, length(text) AS n, md5(text) AS text_md5 FROM kept",
    "row_fates": f"WITH {_MARKED} SELECT fate, count(*) AS n_rows FROM marked GROUP BY fate",
    "row_index": f"WITH {CORPUS} SELECT row_idx, doc_id FROM kept",
    "row_index_composite": """SELECT row_number() OVER (ORDER BY conv_id DESC, turn) - 1 AS row_idx,
        conv_id, turn FROM conversations""",
    "row_batches": f"""WITH {CORPUS} SELECT row_idx // 1000 AS batch, min(row_idx) AS first_row,
        count(*) AS n_rows FROM kept GROUP BY 1""",
    "batch_running_totals": f"WITH {_MARKED} SELECT * FROM running",
    "token_budget_cut": f"WITH {_MARKED} SELECT row_idx, batch, fate FROM taken",
    "prepared_budget": f"""WITH {_MARKED},
        numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM (
          SELECT doc_id, fate, batch FROM taken JOIN (
            SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM raw) USING (row_idx))
          WHERE fate = 'kept'),
        cut AS (SELECT CAST(round_even(CAST(count(*) AS DOUBLE) * 5 / 100, 0) AS BIGINT) AS n FROM numbered)
        SELECT doc_id, row_idx, CASE WHEN row_idx < n THEN 'validation' ELSE 'train' END AS split,
          CASE WHEN row_idx < n THEN row_idx ELSE row_idx - n END AS split_idx FROM numbered, cut""",
    "prepared_validation": f"""WITH {RAW},
        v AS (SELECT item_id AS doc_id, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS text FROM benchmark),
        vn AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM v WHERE length(text) >= 50),
        tn AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM raw WHERE length(text) >= 50)
        SELECT doc_id, n AS row_idx, 'validation' AS split, n AS split_idx, md5(text) AS text_md5 FROM vn
        UNION ALL
        SELECT doc_id, n + (SELECT count(*) FROM vn), 'train', n, md5(text) FROM tn""",
    "corpus_statistics": f"WITH {_MARKED} {_STATS} FROM taken",
    "corpus_statistics_all": f"WITH {_MARKED} {_STATS} FROM marked",
    "head_split": f"WITH {CORPUS} SELECT doc_id, row_idx, split, split_idx FROM corpus",
    "split_sizes": f"WITH {CORPUS} SELECT split, count(*) AS n_rows FROM corpus GROUP BY split",
    "chars_per_token": rf"""WITH {CORPUS} SELECT round(sum(length(text)) /
        sum(len(regexp_extract_all(text, '\S+'))), 6) AS chars_per_token FROM corpus""",
    "row_json": f"WITH {CORPUS} SELECT doc_id, md5(CAST(to_json({{'text': text}}) AS VARCHAR)) AS json_md5 FROM kept",
    "dataset_counts": """SELECT count(*) AS n_rows, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS n_batches
        FROM documents""",
    "feed_rotation": f"""WITH {CORPUS} SELECT row_idx, doc_id,
        (row_idx - 137 + (SELECT count(*) FROM kept)) % (SELECT count(*) FROM kept) AS feed_idx FROM kept""",
    "strided_shards": f"WITH {CORPUS} SELECT row_idx, doc_id, row_idx % 3 AS worker FROM kept",
    "repeated_feed": f"WITH {CORPUS} SELECT row_idx, doc_id, epoch FROM kept, range(3) r(epoch)",
    "head_rows": f"WITH {CORPUS} SELECT row_idx, doc_id FROM kept WHERE row_idx < 400",
}
