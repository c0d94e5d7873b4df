"""Aligning each target token id to one source token id."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocabbridge.functions.hashing import hash_mod, hash_order
from vocabbridge.functions.vectors import l2_normalise, norm
from vocabbridge.operators.dense import as_column, as_matrix, blocks_for, pair_blocks
from vocabbridge.operators.lookup import BROADCAST_BYTES, table_bytes
from vocabbridge.operators.rowindex import with_row_index
from vocabbridge.storage import stored

# The workload's number of pivots and the spellings of the unknown token.
PIVOTS = 300
UNKNOWN_TOKENS = ["unk", "<unk>"]
# Rows per block in the all-pairs search.
BLOCK_ROWS = 4096
# Bytes of the vectors of a group of blocks, and rows of both sides in one matrix product.
GROUP_BYTES = 64 << 20
_STEP_ROWS = 512
_STEP_SOURCES = 4096
# Scores are compared at this many decimals, so that equal vectors tie exactly and
# the block a row falls in cannot decide; the first source row then wins.
SCORE_DECIMALS = 12


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """``id, ord, vector`` scaled to length 1, from ``token, ord, vector``.

    Rows of the unknown token and zero vectors are left out: neither can be a match.
    So is any other token that is not an id.
    """
    is_id = F.col("token").try_cast("int").isNotNull()
    known = vectors.where(~F.col("token").isin(UNKNOWN_TOKENS) & is_id)
    sized = known.withColumn("_norm", norm(F.col("vector"))).where(F.col("_norm") > 0)
    return sized.select(
        F.col("token").try_cast("int").alias("id"),
        "ord",
        l2_normalise(F.col("vector"), F.col("_norm")).alias("vector"),
    )


def choose_pivots(
    gold: DataFrame, target: DataFrame, source: DataFrame, n: int = PIVOTS, seed: int | str = 0
) -> DataFrame:
    """``rank, tgt_id, src_id``: ``n`` gold pairs with vectors on both sides.

    The first ``n`` in a seeded permutation of the target ids; fewer if there are fewer.
    """
    eligible = gold.join(
        target.select(F.col("id").alias("tgt_id")), "tgt_id", "left_semi"
    ).join(source.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    place = hash_order(seed, F.col("tgt_id"))
    first = eligible.withColumn("_place", place).orderBy("_place", "tgt_id").limit(n)
    # At most n rows, so numbering them in one task is bounded.
    rank = F.row_number().over(W.orderBy("_place", "tgt_id")) - 1
    return first.select(rank.alias("rank"), "tgt_id", "src_id")


def relative_vectors(
    vectors: DataFrame,
    pivots: DataFrame,
    pivot_id: str,
    limit_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Each vector replaced by its inner products with the pivot vectors, in rank order.

    Pivot matrices measured to be small go to every task; larger ones are cut into
    blocks that meet the vectors' blocks, and the parts are put together per vector.
    """
    chosen = pivots.select("rank", F.col(pivot_id).alias("id")).join(
        vectors.select("id", F.col("vector").alias("_pivot")), "id"
    ).select("rank", "_pivot")
    if table_bytes(chosen) > limit_bytes:
        return _relative_in_blocks(vectors, chosen, block_rows)
    rows = chosen.orderBy("rank").toArrow()
    if rows.num_rows == 0:
        raise ValueError("no gold pair has vectors on both sides")
    matrix = np.ascontiguousarray(as_matrix(rows.column("_pivot"), 0).T)
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)

    def project(batches):
        for batch in batches:
            rep = as_matrix(pa.chunked_array([batch.column("vector")]), 0) @ shared.value
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("ord"), as_column(rep)], names=["id", "ord", "vector"]
            )

    return vectors.where(F.size("vector") > 0).select("id", "ord", "vector").mapInArrow(
        project, "id int, ord bigint, vector array<double>"
    )


def _relative_in_blocks(vectors: DataFrame, chosen: DataFrame, block_rows: int) -> DataFrame:
    def products(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows == 0:
            left = left.slice(0, 0)
        rep = np.zeros((0, 1))
        if left.num_rows:
            rep = as_matrix(left.column("vector"), 0) @ as_matrix(right.column("_pivot"), 0).T
        ranks = np.resize(right.column("rank").to_numpy(), rep.shape).astype(np.int32)
        return pa.table(
            {
                "id": left.column("id"),
                "ord": left.column("ord"),
                "ranks": as_column(ranks),
                "part": as_column(rep),
            }
        )

    parts = pair_blocks(
        vectors.select("id", "ord", "vector"), chosen, "id", "rank", block_rows
    ).applyInArrow(products, "id int, ord bigint, ranks array<int>, part array<double>")
    # Collected per vector: one number per pivot.
    joined = parts.groupBy("id", "ord").agg(
        F.sort_array(
            F.flatten(F.collect_list(F.arrays_zip("ranks", "part")))
        ).alias("_pairs")
    )
    return joined.select("id", "ord", F.transform("_pairs", lambda p: p["part"]).alias("vector"))


_LOCAL = "tgt_id int, src_id int, ord bigint, score double"
_BEST_TYPES = {"tgt_id": np.int32, "src_id": np.int32, "ord": np.int64, "score": np.float64}
# What rounding may add to a score or to a product of lengths.
_ROUNDING = 1e-9


def _best_of_blocks(k: int):
    """The ``k`` best source rows of a group for each target row of a group.

    Products are taken a step of rows of both sides at a time.  What a target row has found
    so far is a floor, and only scores that reach it are looked at again.  Target rows may
    have a ``_limit``: source rows from that ``_place`` on have nothing for them.
    """

    def best(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {name: [] for name in _BEST_TYPES}
        if left.num_rows and right.num_rows:
            limited = "_limit" in left.column_names
            place = right.column("_place" if limited else "ord").to_numpy()
            order = np.argsort(place, kind="stable")
            place, src, ords = place[order], right.column("id").to_numpy()[order], right.column("ord").to_numpy()[order]
            s = np.ascontiguousarray(as_matrix(right.column("vector"), 0)[order])
            t, ids = as_matrix(left.column("vector"), 0), left.column("id").to_numpy()
            if limited:
                limit = left.column("_limit").to_numpy()
                order = np.argsort(-limit, kind="stable")
                t, ids = t[order], ids[order]
                ends = np.searchsorted(place, limit[order])
            else:
                ends = np.full(len(ids), len(src))
            for at in range(0, len(t), _STEP_ROWS):
                part, end = t[at : at + _STEP_ROWS], ends[at]
                row, found, score = _best_of_step(part, s[:end], ords, k)
                out["tgt_id"].append(ids[at + row])
                out["src_id"].append(src[found])
                out["ord"].append(ords[found])
                out["score"].append(score)
        return pa.table(
            {name: pa.array(np.concatenate([*out[name], np.array([], t)]).astype(t)) for name, t in _BEST_TYPES.items()}
        )

    return best


def _best_of_step(part: np.ndarray, s: np.ndarray, ords: np.ndarray, k: int):
    """Row of ``part``, row of ``s`` and score of the ``k`` best of each row; ties to the lower ``ord``."""
    row, col, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor = np.full(len(part), -np.inf)
    for begin in range(0, len(s), _STEP_SOURCES):
        raw = part @ s[begin : begin + _STEP_SOURCES].T
        if begin == 0 and raw.shape[1] > k:
            kth = np.partition(raw, -k, axis=1)[:, -k]
            floor = np.where(np.isnan(kth), np.inf, kth)
        # Not below, with the margin of a rounding; scores that are no numbers count as the largest.
        r, c = np.nonzero(~(raw < (floor - 10.0**-SCORE_DECIMALS)[:, None]))
        row, col = np.concatenate([row, r]), np.concatenate([col, c + begin])
        score = np.concatenate([score, np.round(raw[r, c], SCORE_DECIMALS)])
        size = np.where(np.isnan(score), np.inf, score)
        order = np.lexsort((ords[col], -size, row))
        row, col, score, size = row[order], col[order], score[order], size[order]
        first = np.searchsorted(row, row)
        kept = np.arange(len(row)) - first < k
        row, col, score, size = row[kept], col[kept], score[kept], size[kept]
        last = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
        floor[row[last]] = size[last]
    return row, col, score


def _group_rows(target: DataFrame, source: DataFrame, block_rows: int) -> int:
    """Rows of the groups that meet in one task, a multiple of ``block_rows``.

    A row is sent once per group of the other side.  There are just enough groups for all
    cores, and more only where a group would outgrow ``GROUP_BYTES``.
    """
    sizes = [side.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first() for side in (target, source)]
    rows, dims = max(n for n, _ in sizes), max(d or 1 for _, d in sizes)
    side = math.ceil(math.sqrt(4 * max(8, target.sparkSession.sparkContext.defaultParallelism)))
    most = min(-(-rows // side), GROUP_BYTES // (8 * max(1, dims)))
    return max(1, most // block_rows) * block_rows


def _by_length(vectors: DataFrame, block_rows: int) -> DataFrame:
    """The vectors with their length, in blocks from the longest to the shortest."""
    measured = vectors.withColumn("_norm", norm(F.col("vector")))
    numbered = with_row_index(measured, F.desc("_norm"), F.asc("id"), name="_place")
    return numbered.withColumn("_block", F.floor(F.col("_place") / block_rows).cast("int"))


def open_blocks(target: DataFrame, source: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``_lb, _blocks``: how many of the first source blocks each target block has to meet.

    Both sides come from :func:`_by_length`; ``found`` has scores that the target rows
    reach already.  No score exceeds the product of the two lengths (Cauchy and Schwarz),
    so a source block whose longest vector is shorter than score / length for every row of
    a target block has nothing for it, and neither have the blocks after it.  One number
    per block is collected.
    """
    reached = found.groupBy(F.col("tgt_id").alias("id")).agg(
        F.min("score").alias("_score"), F.count(F.lit(1)).alias("_n")
    )
    bound = (F.col("_score") - _ROUNDING) / (F.col("_norm") * (1 + _ROUNDING))
    need = F.when((F.col("_n") >= k) & (F.col("_norm") > 0), bound).otherwise(float("-inf"))
    needs = (
        target.join(reached, "id", "left").groupBy("_block").agg(F.min(F.coalesce(need, F.lit(float("-inf")))).alias("_need"))
    ).toPandas()
    longest = source.groupBy("_block").agg(F.max("_norm").alias("_longest")).orderBy("_block").toPandas()
    falling = -longest["_longest"].to_numpy()
    count = np.searchsorted(falling, -needs["_need"].to_numpy(), side="right")
    rows = [(int(b), int(n)) for b, n in zip(needs["_block"], count, strict=True)]
    return target.sparkSession.createDataFrame(rows, "_lb int, _blocks int")


def _pruned(target: DataFrame, source: DataFrame, k: int, block_rows: int, group_rows: int, best) -> DataFrame:
    """The best of all block pairs that can hold one of the ``k`` best scores.

    All target blocks meet the longest source vectors first.  What they find there bounds
    the rest.  Consecutive blocks travel in groups, so that a row is sent once per group
    of the other side, and a target row in a group meets only the blocks it has to.
    """
    left, right = _by_length(target, block_rows), _by_length(source, block_rows)
    per = group_rows // block_rows
    left = left.withColumn("_lg", F.floor(F.col("_block") / per).cast("int"))
    right = right.withColumn("_rg", F.floor(F.col("_block") / per).cast("int"))

    def met(l_rows: DataFrame, r_rows: DataFrame) -> DataFrame:
        l_rows = l_rows.select("_lg", "_rg", "id", "vector", "_limit")
        r_rows = r_rows.select(F.col("_lg").alias("_l2"), F.col("_rg").alias("_r2"), "id", "ord", "vector", "_place")
        return l_rows.groupBy("_lg", "_rg").cogroup(r_rows.groupBy("_l2", "_r2")).applyInArrow(best, _LOCAL)

    groups = left.select("_lg").distinct()
    longest = right.where(F.col("_block") == 0).join(F.broadcast(groups))
    every = left.withColumns({"_rg": F.lit(0), "_limit": F.lit(block_rows).cast("bigint")})
    first = stored(met(every, longest), "first-scores")
    further = open_blocks(left, right, first, k).where("_blocks > 1")
    # One row per target block and one per target group.
    bounds = further.select(F.col("_lb").alias("_block"), "_blocks", (F.col("_blocks").cast("bigint") * block_rows).alias("_limit"))
    l_rows = left.join(F.broadcast(bounds), "_block").withColumn(
        "_rg", F.explode(F.sequence(F.lit(0), F.floor((F.col("_blocks") - 1) / per).cast("int")))
    )
    deepest = further.groupBy(F.floor(F.col("_lb") / per).cast("int").alias("_lg")).agg(F.max("_blocks").alias("_deepest"))
    rest = right.where(F.col("_block") > 0)
    r_rows = rest.join(F.broadcast(deepest), F.col("_block") < F.col("_deepest"))
    return first.unionAll(met(l_rows, r_rows))


def nearest(
    target: DataFrame,
    source: DataFrame,
    k: int = 1,
    metric: str = "dot",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``tgt_id, src_id, score, rank``: the ``k`` best source rows for each target row.

    Groups of target and of source blocks meet in a task, a step of rows in one matrix
    product, and only the ``k`` best per target row leave the task.  Equal scores go to the lower ``ord``.  For inner products
    blocks are cut by length, and block pairs that cannot hold a better score are left out
    (:func:`open_blocks`); cosines leave nothing to bound, so all pairs meet.
    """
    if metric not in ("dot", "cosine"):
        raise ValueError("metric must be dot or cosine")
    if metric == "cosine":
        target, source = (
            side.withColumn("vector", l2_normalise(F.col("vector"))).where(F.col("vector").isNotNull())
            for side in (target, source)
        )

    target, source = target.select("id", "vector"), source.select("id", "ord", "vector")
    best, group_rows = _best_of_blocks(k), _group_rows(target, source, block_rows)
    if metric == "cosine" or blocks_for(source, block_rows) == 1:
        local = pair_blocks(target, source, "id", "id", group_rows).applyInArrow(best, _LOCAL)
    else:
        local = _pruned(target, source, k, block_rows, group_rows, best)
    if k == 1:
        winner = F.max_by(F.struct("src_id", "score"), F.struct("score", (-F.col("ord")).alias("o")))
        found = local.groupBy("tgt_id").agg(winner.alias("_best"))
        return found.select("tgt_id", "_best.src_id", "_best.score", F.lit(1).alias("rank"))
    # k rows per source group and target row, a bounded window.
    ranked = W.partitionBy("tgt_id").orderBy(F.desc("score"), "ord")
    return (
        local.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("tgt_id", "src_id", "score", "rank")
    )


def random_source(tgt_id: Column, source_size: int, seed: int | str = 0) -> Column:
    """A source id drawn from a hash of the target id."""
    return hash_mod(seed, source_size, tgt_id).cast("int")


def resolve(
    target_size: int,
    source_size: int,
    gold: DataFrame,
    best: DataFrame,
    spark,
    seed: int | str = 0,
) -> DataFrame:
    """``tgt_id, src_id, origin`` for every id in ``0..target_size-1``.

    A gold pair wins, then the nearest vector, then a random source id.
    """
    ids = spark.range(target_size).select(F.col("id").cast("int").alias("tgt_id"))
    known = gold.select(F.col("tgt_id").cast("int"), F.col("src_id").cast("int").alias("_gold"))
    near = best.select(F.col("tgt_id").cast("int"), F.col("src_id").cast("int").alias("_near"))
    joined = ids.join(known, "tgt_id", "left").join(near, "tgt_id", "left")
    origin = (
        F.when(F.col("_gold").isNotNull(), "gold")
        .when(F.col("_near").isNotNull(), "vector")
        .otherwise("random")
    )
    picked = F.coalesce("_gold", "_near", random_source(F.col("tgt_id"), source_size, seed))
    return joined.select("tgt_id", picked.alias("src_id"), origin.alias("origin"))


def without_gold(target: DataFrame, gold: DataFrame) -> DataFrame:
    """The vectors whose nearest neighbour :func:`resolve` can ask for: no gold pair wins over it."""
    pairs = gold.select(F.col("tgt_id").cast("int").alias("id"), F.col("src_id").cast("int").isNotNull().alias("_found"))
    settled = pairs.groupBy("id").agg(F.min("_found").alias("_found")).where("_found").select("id")
    return target.join(settled, "id", "left_anti")


def without_vector(target_size: int, gold: DataFrame, target: DataFrame, spark) -> DataFrame:
    """Target ids with neither a gold pair nor a vector."""
    ids = spark.range(target_size).select(F.col("id").cast("int").alias("tgt_id"))
    return ids.join(gold.select("tgt_id"), "tgt_id", "left_anti").join(
        target.select(F.col("id").alias("tgt_id")), "tgt_id", "left_anti"
    )


def origin_counts(alignment: DataFrame) -> DataFrame:
    """Target ids by the way they were aligned."""
    return alignment.groupBy("origin").agg(F.count(F.lit(1)).alias("n_ids"))
