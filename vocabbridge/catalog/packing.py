"""Packing and feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocabbridge.catalog.common import CORPUS, SRC, TGT, plain, prepared, source, stage, target
from vocabbridge.functions.sequences import ids_to_line
from vocabbridge.operators import packing as P
from vocabbridge.plans import stages
from vocabbridge.storage import SMALL, stored
from vocabbridge.streaming import feed as S

BLOCK = 128
# Characters a buffer holds: 8 blocks at 3.6 characters per token.
LIMIT = P.buffer_limit(BLOCK, 3.6, 8)
EOS = 1_000_002
# Row at which the rotated feed starts, and rows of the corpus that is shorter than a buffer.
ROTATED = 10
SHORT = 7


def _lines(blocks, *keys):
    return plain(
        blocks.select(
            *keys,
            F.size("input_ids").alias("n_ids"),
            F.md5(ids_to_line(F.col("input_ids"))).alias("ids_md5"),
        )
    )


def _tokens_with_length(spark, folder):
    """Source tokens of the whole corpus with the characters of their text."""

    def build():
        chars = prepared(spark, folder).select("row_idx", F.length("text").cast("bigint").alias("n_chars"))
        tokens = source(spark, folder).rows.select("row_idx", "input_ids")
        return stored(tokens.join(chars, "row_idx"), "lengths", compression=SMALL)

    return stage(spark, folder, "lengths", build)


def packed_blocks(spark, folder):
    blocks = stages.training_blocks(target(spark, folder), BLOCK)
    return _lines(blocks, "split", "shard", "batch", "block")


def packed_blocks_sharded(spark, folder):
    rows = target(spark, folder).rows.select("split", "split_idx", "input_ids")
    blocks = P.pack(rows, BLOCK, batch_rows=100, shards=3)
    return _lines(blocks, "split", "shard", "batch", "block")


def packed_blocks_with_end(spark, folder):
    rows = source(spark, folder).rows.select("split", "split_idx", "input_ids")
    blocks = P.pack(P.append_end(rows, EOS), BLOCK, batch_rows=50)
    return _lines(blocks, "split", "shard", "batch", "block")


def packed_types(spark, folder):
    blocks = stages.training_blocks(target(spark, folder), BLOCK)
    typed = blocks.select(
        "split",
        F.typeof("input_ids").alias("ids_type"),
        F.typeof("attention_mask").alias("mask_type"),
        (F.size("input_ids") == F.size("attention_mask")).alias("same_size"),
    )
    return typed.groupBy("split", "ids_type", "mask_type", "same_size").agg(
        F.count(F.lit(1)).alias("n_blocks")
    )


def packed_feed(spark, folder):
    blocks = stages.training_blocks(target(spark, folder), BLOCK).where(F.col("split") == "train")
    examples = S.packed_feed(blocks, BLOCK)
    equal = F.col("input_ids") == F.col("labels")
    return examples.agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.count_if(equal).alias("n_equal_labels"),
        F.sum(F.aggregate("labels", F.lit(0).cast("bigint"), lambda acc, x: acc + x)).alias("label_sum"),
    )


def wrong_lengths(spark, folder):
    rows = target(spark, folder).rows
    return plain(S.wrong_lengths(rows, BLOCK).select("row_idx", F.size("input_ids").alias("n_ids")))


def feed_buffers(spark, folder):
    rows = _tokens_with_length(spark, folder).select("row_idx", "n_chars")
    return P.assign_buffers(rows, "n_chars", LIMIT).select("row_idx", "buffer")


def buffered_blocks(spark, folder):
    blocks = P.pack_buffers(_tokens_with_length(spark, folder), BLOCK, "n_chars", LIMIT)
    return _lines(blocks, "buffer", "block")


def buffered_feed_shuffled(spark, folder):
    examples = S.buffered_feed(
        _tokens_with_length(spark, folder), BLOCK, LIMIT, eos=EOS, shuffle=True, seed=7
    )
    return _lines(examples, "buffer", "block", "place")


def repeated_buffered_feed(spark, folder):
    """The whole feed: rotated, read three times without a break, packed, shuffled in buffers."""
    examples = S.feed(
        _tokens_with_length(spark, folder), BLOCK, LIMIT, start=ROTATED, epochs=3, eos=EOS, seed=7
    )
    return _lines(examples, "epoch", "buffer", "block", "place")


def repeated_short_buffers(spark, folder):
    """Where buffers begin over five epochs, with buffers longer than an epoch."""
    rows = _tokens_with_length(spark, folder).select("row_idx", "n_chars")
    rows = rows.where(F.col("row_idx") < SHORT)
    placed, table = P.repeated_buffers(rows, "n_chars", 2.5 * LIMIT, 5)
    whole = placed.join(F.broadcast(table), "class")
    return plain(
        whole.groupBy("epoch", "buffer").agg(
            F.count(F.lit(1)).alias("n_rows"), (F.max("place") - F.min("place") + 1).alias("n_places")
        )
    )


QUERIES = {
    f.__name__: f
    for f in (
        packed_blocks, packed_blocks_sharded, packed_blocks_with_end, packed_types, packed_feed,
        wrong_lengths, feed_buffers, buffered_blocks, buffered_feed_shuffled,
        repeated_buffered_feed, repeated_short_buffers,
    )
}


def _cut_sql(keys: str, tok: str, block: int, keep: str, order: str = "row_idx") -> str:
    """Number the ids of each group in order and cut every ``block``."""
    return f"""placed AS (
      SELECT {keys}, token_id,
        row_number() OVER (PARTITION BY {keys} ORDER BY {order}, pos) - 1 AS place FROM {tok}
    ),
    blocks AS (
      SELECT {keys}, place // {block} AS block, count(*) AS n_ids,
        md5(string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY place)) AS ids_md5,
        CAST(sum(token_id) AS BIGINT) AS id_sum
      FROM placed GROUP BY {keys}, place // {block}
    ),
    cut_blocks AS (SELECT * FROM blocks WHERE n_ids = {block}{keep})"""


_KEEP_SHORT = " OR (block = 0 AND split <> 'train')"
_T = f"""WITH {CORPUS},{TGT},
  batched AS (SELECT *, 0::BIGINT AS shard, split_idx // 1000 AS batch FROM tgt_tok),
  {_cut_sql('split, shard, batch', 'batched', BLOCK, _KEEP_SHORT, 'split_idx')}"""

_BUFFERS = f"""chars AS (SELECT row_idx, length(text) AS n_chars FROM corpus),
  walk(row_idx, buffer, filled) AS (
    SELECT row_idx, row_idx, n_chars FROM chars WHERE row_idx = 0
    UNION ALL
    SELECT c.row_idx,
      CASE WHEN w.filled >= {LIMIT} THEN c.row_idx ELSE w.buffer END,
      CASE WHEN w.filled >= {LIMIT} THEN c.n_chars ELSE w.filled + c.n_chars END
    FROM walk w JOIN chars c ON c.row_idx = w.row_idx + 1
  )"""


def _walk_epochs(rows: str, epochs: int, limit: float) -> str:
    """Buffers over repeated epochs, row by row; ``rows`` has ``row_idx`` (dense) and ``n_chars``."""
    return f"""size AS (SELECT count(*) AS n FROM {rows}),
  walk(seq, buffer, filled) AS (
    SELECT 0::BIGINT, 0::BIGINT, n_chars FROM {rows} WHERE row_idx = 0
    UNION ALL
    SELECT w.seq + 1,
      CASE WHEN w.filled >= {limit} THEN w.seq + 1 ELSE w.buffer END,
      CASE WHEN w.filled >= {limit} THEN c.n_chars ELSE w.filled + c.n_chars END
    FROM walk w JOIN size ON w.seq + 1 < {epochs} * n JOIN {rows} c ON c.row_idx = (w.seq + 1) % n
  ),
  begun AS (SELECT seq, seq % n AS row_idx, buffer // n AS epoch, buffer % n AS buffer FROM walk, size)"""


_B = f"WITH RECURSIVE {CORPUS},{SRC},{_BUFFERS}"

SQL = {
    "packed_blocks": f"{_T} SELECT split, shard, batch, block, n_ids, ids_md5 FROM cut_blocks",
    "packed_blocks_sharded": f"""WITH {CORPUS},{TGT},
        sizes AS (SELECT split, count(*) AS n FROM corpus GROUP BY split),
        parts AS (SELECT *, n // 3 AS q, n % 3 AS r FROM sizes),
        dealt AS (SELECT row_idx, CASE WHEN split_idx < r * (q + 1) THEN split_idx // (q + 1)
            ELSE r + (split_idx - r * (q + 1)) // q END AS shard, q, r, split_idx
          FROM corpus JOIN parts USING (split)),
        batched AS (SELECT t.*, shard,
            (t.split_idx - (shard * q + least(shard, r))) // 100 AS batch
          FROM tgt_tok t JOIN dealt USING (row_idx)),
        {_cut_sql('split, shard, batch', 'batched', BLOCK, _KEEP_SHORT, 'split_idx')}
        SELECT split, shard, batch, block, n_ids, ids_md5 FROM cut_blocks""",
    "packed_blocks_with_end": f"""WITH {CORPUS},{SRC},
        batched AS (
          SELECT split, 0::BIGINT AS shard, split_idx // 50 AS batch, split_idx, pos, token_id FROM src_tok
          UNION ALL
          SELECT split, 0, split_idx // 50, split_idx, 1000000000000, {EOS} FROM corpus),
        {_cut_sql('split, shard, batch', 'batched', BLOCK, _KEEP_SHORT, 'split_idx')}
        SELECT split, shard, batch, block, n_ids, ids_md5 FROM cut_blocks""",
    "packed_types": f"""{_T} SELECT split, 'array<int>' AS ids_type, 'array<boolean>' AS mask_type,
        true AS same_size, count(*) AS n_blocks FROM cut_blocks GROUP BY split""",
    "packed_feed": f"""{_T} SELECT count(*) AS n_examples, count(*) AS n_equal_labels,
        CAST(sum(id_sum) AS BIGINT) AS label_sum FROM cut_blocks WHERE split = 'train'""",
    "wrong_lengths": f"""WITH {CORPUS},{TGT} SELECT row_idx, count(*) AS n_ids FROM tgt_tok
        GROUP BY row_idx HAVING count(*) <> {BLOCK}""",
    "feed_buffers": f"WITH RECURSIVE {CORPUS},{_BUFFERS} SELECT row_idx, buffer FROM walk",
    "buffered_blocks": f"""{_B},
        tok AS (SELECT buffer, row_idx, pos, token_id FROM src_tok JOIN walk USING (row_idx)),
        {_cut_sql('buffer', 'tok', BLOCK, '')}
        SELECT buffer, block, n_ids, ids_md5 FROM cut_blocks""",
    "buffered_feed_shuffled": f"""{_B},
        tok AS (SELECT buffer, row_idx, pos, token_id FROM src_tok JOIN walk USING (row_idx)
          UNION ALL SELECT buffer, row_idx, 1000000000000, {EOS} FROM walk),
        {_cut_sql('buffer', 'tok', BLOCK, '')}
        SELECT buffer, block, n_ids, ids_md5, row_number() OVER (PARTITION BY buffer
          ORDER BY md5('7:' || buffer || ':' || block), block) - 1 AS place FROM cut_blocks""",
    "repeated_buffered_feed": f"""WITH RECURSIVE {CORPUS},{SRC},
        turned AS (SELECT (row_idx - {ROTATED} + (SELECT count(*) FROM corpus)) % (SELECT count(*) FROM corpus) AS row_idx,
          row_idx AS stored_idx, length(text) AS n_chars FROM corpus),
        {_walk_epochs("turned", 3, LIMIT)},
        tok AS (SELECT epoch, buffer, seq, pos, token_id
          FROM src_tok s JOIN turned t ON s.row_idx = t.stored_idx JOIN begun b ON b.row_idx = t.row_idx
          UNION ALL SELECT epoch, buffer, seq, 1000000000000, {EOS} FROM begun),
        {_cut_sql('epoch, buffer', 'tok', BLOCK, '', 'seq')}
        SELECT CAST(epoch AS INTEGER) AS epoch, buffer, block, n_ids, ids_md5, row_number() OVER (PARTITION BY epoch, buffer
          ORDER BY md5('7:' || epoch || ':' || buffer || ':' || block), block) - 1 AS place FROM cut_blocks""",
    "repeated_short_buffers": f"""WITH RECURSIVE {CORPUS},
        short AS (SELECT row_idx, length(text) AS n_chars FROM corpus WHERE row_idx < {SHORT}),
        {_walk_epochs("short", 5, 2.5 * LIMIT)}
        SELECT CAST(epoch AS INTEGER) AS epoch, buffer, count(*) AS n_rows, max(seq) - min(seq) + 1 AS n_places
        FROM begun GROUP BY epoch, buffer""",
}
