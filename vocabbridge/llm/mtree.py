"""Exact top-k inner products with M-trees.

Vectors become integers and get one more coordinate, so that all have the same length;
then the larger inner product is the smaller distance, and a metric tree can answer.
Vectors are dealt to the nearest of a bounded number of pivots, and pivots with many
vectors to several trees.  A tree is a table of pages: a page has a center, a covering
radius, the distance to its parent's center, and the entries of a leaf.  A query first
visits the tree with the nearest center, which gives it a k-th best score; it then goes
to every other tree whose covering ball can hold a better one.  Inside a tree it walks
down, and skips a page when the stored distance to the parent's center (by the triangle
inequality, no distance is computed then) or the distance to the page's center says
that the ball is too far; leaves are visited nearest bound first.

A page's center is one of its vectors, and a leaf keeps the distance of each entry to it,
so entries too are passed over by a stored distance.

Scores are sums of integers and exact: products are floats while these hold them, 64-bit
integers beyond.  Bounds are loosened by what rounding may add, in proportion to the
longest vector.

Equal vectors are one entry with its k + 1 smallest ids: no other id of theirs can be in
a result.  Vectors that are null or hold null or non-finite components take no part,
neither as queries nor as candidates.  Vectors of different lengths have no inner product:
each length is searched on its own.  Vectors whose squared length is 2^62 or more (a
component of some 3 * 10^7) have scores that are no 64-bit integers and take no part either.
Ties go to the smaller id.  Rows that repeat an id are candidates as
often as they occur.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocabbridge.storage import stored

# Components are floor(SCALE * x).
SCALE = 64
# Pivots at most, vectors aimed at per pivot, and vectors per tree at most.
PIVOTS = 1024
PER_PIVOT = 8192
PER_TREE = 65_536
# Entries of a leaf page and children of an inner page.
PAGE = 64
FAN_OUT = 16
# Queries that one task takes into a tree.
QUERY_BLOCK = 65_536
# What rounding may add to a squared distance, as a share of the longest squared length.
ROUNDING = 1e-13
# Squared lengths below these are summed exactly as floats, and as 64-bit integers.
FLOAT_EXACT, LONG_EXACT = float(1 << 53), float(1 << 62)
# A score below all others.
NOTHING = -(1 << 62)
SEED = 3


def quantised(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, v``: integer vectors, without those that take no part."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    floored = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("double"))
    # Floor gives longs, so what is too large is left out before it.
    small = F.forall(x, lambda c: F.abs(c.cast("double")) < float(1 << 31) / SCALE)
    kept = vectors.where(x.isNotNull() & F.coalesce(finite & small, F.lit(False)) & (F.size(x) > 0))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    rows = kept.select(F.col(vec_id).cast("long").alias("vec_id"), floored.alias("v")).where(square < LONG_EXACT)
    return rows.select("vec_id", F.col("v").cast("array<long>").alias("v"))


def slack(norm: float) -> float:
    """What rounding may add to a distance between lifted vectors of squared length ``norm``."""
    return 1e-6 + 4 * float(np.sqrt(ROUNDING * norm))


def _matrix(column) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.zeros((0, 1))


def lifted(v: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the coordinate that makes all squared lengths ``norm``."""
    v = v.astype(float)
    rest = np.sqrt(np.maximum(norm - (v * v).sum(axis=1), 0))
    return np.concatenate([v, rest[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def build_pages(points: np.ndarray) -> list[tuple[int, int, np.ndarray, float, float, np.ndarray, np.ndarray]]:
    """(page, parent, center, radius, distance to the parent's center, entries, their distances) from the root.

    Inner pages have no entries of their own.  Members of a page are dealt to the nearest
    of a few of them, chosen far from each other.
    """
    pages = []
    todo = [(np.arange(len(points)), -1, None)]
    while todo:
        members, parent, above = todo.pop()
        own = points[members]
        middle = ((own - own.mean(axis=0)) ** 2).sum(axis=1).argmin()
        center = own[middle]
        away = np.sqrt(((own - center) ** 2).sum(axis=1))
        to_parent = float(np.sqrt(((center - above) ** 2).sum())) if above is not None else 0.0
        page = len(pages)
        leaf = len(members) <= PAGE
        pages.append((page, parent, center, float(away.max()), to_parent, members if leaf else members[:0], away if leaf else away[:0]))
        if leaf:
            continue
        chosen = [int(away.argmax())]
        nearest = distances(own, own[chosen])[:, 0]
        while len(chosen) < min(FAN_OUT, -(-len(members) // (PAGE // 2))):
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(own, own[chosen[-1:]])[:, 0])
        side = distances(own, own[chosen]).argmin(axis=1)
        groups = [members[side == i] for i in range(len(chosen))]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:  # no metric split: halve
            groups = [members[: len(members) // 2], members[len(members) // 2 :]]
        todo += [(g, page, center) for g in groups]
    return pages


class Tree:
    """The pages of a tree, ready to be asked."""

    def __init__(self, table: pa.Table):
        order = np.argsort(np.asarray(table.column("page")))
        table = table.take(pa.array(order))
        self.center = _matrix(table.column("center"))
        self.radius, self.to_parent = np.asarray(table.column("radius")), np.asarray(table.column("to_parent"))
        parent = np.asarray(table.column("parent"))
        self.children: list[list[int]] = [[] for _ in parent]
        for page, above in enumerate(parent):
            if above >= 0:
                self.children[above].append(page)
        self.entries = [np.array(x, np.int64).reshape(-1, self.center.shape[1] - 1) for x in table.column("vectors").to_pylist()]
        self.away = [np.array(x, float) for x in table.column("away").to_pylist()]
        # Ids of a page's entries back to back, and the entry that each belongs to.
        ids = table.column("ids").to_pylist()
        self.ids = [np.array([i for own in page for i in own], np.int64) for page in ids]
        self.entry_of = [np.repeat(np.arange(len(page)), [len(own) for own in page]) for page in ids]

    def search(self, queries: np.ndarray, own: np.ndarray, worst: np.ndarray, k: int, norm: float):
        """Per query the best scores and ids of the tree; ``worst`` are scores to reach."""
        point = np.concatenate([queries.astype(float), np.zeros((len(queries), 1))], axis=1)
        length, loose = (point * point).sum(axis=1), slack(norm)
        top = np.full((len(queries), k), NOTHING), np.full((len(queries), k), -NOTHING)

        def reach(rows):
            """The largest distance at which a vector still reaches the score."""
            return np.sqrt(np.maximum(length[rows] + norm - 2.0 * worst[rows], 0)) + loose

        frontier: list[tuple[float, int, np.ndarray, np.ndarray]] = []
        rows = np.arange(len(queries))
        away = distances(point, self.center[:1])[:, 0]
        frontier.append((float((away - self.radius[0]).min(initial=0)), 0, rows, away))
        while frontier:
            _, page, rows, away = heapq.heappop(frontier)
            near = away - self.radius[page] <= reach(rows)
            rows, away = rows[near], away[near]
            if not len(rows):
                continue
            if not self.children[page]:
                # Entries whose stored distance to the center says that they are too far are left out.
                close = np.abs(away[:, None] - self.away[page][None]) <= reach(rows)[:, None]
                some, entries = close.any(axis=1), np.flatnonzero(close.any(axis=0))
                if len(entries):
                    self._visit(page, entries, queries, rows[some], own, worst, norm, *top)
                continue
            for child in self.children[page]:
                # The stored distance first; only who passes has a distance computed.
                maybe = np.abs(away - self.to_parent[child]) - self.radius[child] <= reach(rows)
                some = rows[maybe]
                if not len(some):
                    continue
                there = distances(point[some], self.center[child : child + 1])[:, 0]
                ok = there - self.radius[child] <= reach(some)
                if ok.any():
                    bound = float((there[ok] - self.radius[child]).min())
                    heapq.heappush(frontier, (bound, child, some[ok], there[ok]))
        return top

    def _visit(self, page, entries, queries, rows, own, worst, norm, top_scores, top_ids):
        asked, vectors = queries[rows], self.entries[page][entries]
        if norm < FLOAT_EXACT:
            scores = np.rint(asked.astype(float) @ vectors.T.astype(float)).astype(np.int64)
        else:
            scores = asked.astype(np.int64) @ vectors.T
        some = (scores >= worst[rows][:, None]).any(axis=1)
        held = np.isin(self.entry_of[page], entries)
        places = np.searchsorted(entries, self.entry_of[page][held])
        page_ids = self.ids[page][held]
        rows, scores = rows[some], scores[some][:, places]
        if not len(rows):
            return
        ids = np.broadcast_to(page_ids, scores.shape)
        scores = np.where(ids == own[rows][:, None], NOTHING, scores)
        scores = np.concatenate([top_scores[rows], scores], axis=1)
        ids = np.concatenate([top_ids[rows], ids], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : top_ids.shape[1]]
        top_scores[rows] = np.take_along_axis(scores, order, 1)
        top_ids[rows] = np.take_along_axis(ids, order, 1)
        worst[rows] = np.maximum(worst[rows], top_scores[rows, -1])


def build(entries: DataFrame, norm: float) -> tuple[DataFrame, np.ndarray]:
    """Pages of all trees (stored), and center and radius of every tree's root.

    ``entries``: ``v`` and ``ids``, stored.  The number of trees is at most ``PIVOTS`` plus
    one per ``PER_TREE`` vectors; a root is one short row.
    """
    n = entries.count()
    wanted = max(1, min(PIVOTS, n // PER_PIVOT))
    order = F.xxhash64(F.lit(SEED), "v")
    pivots = entries.orderBy(order, "v").limit(wanted).select("v").toPandas()["v"].tolist()
    spark = entries.sparkSession
    shared = spark.sparkContext.broadcast(lifted(np.array(pivots), norm))

    def nearest(batches):
        for batch in batches:
            side = distances(lifted(_matrix(batch.column("v")), norm), shared.value).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(side.astype(np.int32))], names=[*batch.schema.names, "pivot"])

    dealt = stored(entries.mapInArrow(nearest, "v array<long>, ids array<long>, pivot int"), "dealt")
    sizes = dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / PER_TREE).cast("long")
    tree = F.concat_ws("-", "pivot", F.pmod(F.xxhash64("v"), parts))
    placed = dealt.join(F.broadcast(sizes), "pivot").select(tree.alias("tree"), "v", "ids")

    def make(table):
        v = _matrix(table.column("v"))
        ids = table.column("ids").to_pylist()
        pages = build_pages(lifted(v, norm))
        return pa.table(
            {
                "tree": [table.column("tree")[0].as_py()] * len(pages),
                "page": pa.array([p[0] for p in pages], pa.int32()),
                "parent": pa.array([p[1] for p in pages], pa.int32()),
                "center": pa.array([p[2].tolist() for p in pages], pa.list_(pa.float64())),
                "radius": pa.array([p[3] + slack(norm) for p in pages]),
                "to_parent": pa.array([p[4] for p in pages]),
                "vectors": pa.array([v[p[5]].tolist() for p in pages], pa.list_(pa.list_(pa.int64()))),
                "away": pa.array([p[6].tolist() for p in pages], pa.list_(pa.float64())),
                "ids": pa.array([[ids[i] for i in p[5]] for p in pages], pa.list_(pa.list_(pa.int64()))),
            }
        )

    pages = stored(placed.groupBy("tree").applyInArrow(make, PAGES), "pages")
    roots = pages.where("page = 0").select("tree", "center", "radius").orderBy("tree").toPandas()
    return pages, roots


PAGES = (
    "tree string, page int, parent int, center array<double>, radius double, to_parent double, "
    "vectors array<array<long>>, away array<double>, ids array<array<long>>"
)


def _ask(pages: DataFrame, routed: DataFrame, k: int, norm: float) -> DataFrame:
    """``query_id, score, vec_id`` from trees, for ``tree, query_id, v, worst`` rows."""

    def run(left, right):
        tree = Tree(left.drop_columns(["block"]))
        own = np.asarray(right.column("query_id"))
        worst = np.asarray(right.column("worst")).copy()
        scores, ids = tree.search(_matrix(right.column("v")), own, worst, k, norm)
        row, place = np.nonzero(scores > NOTHING)
        return pa.table({"query_id": own[row], "score": scores[row, place], "vec_id": ids[row, place]})

    def both(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "score", "vec_id")})
        return run(left, right)

    blocks = routed.groupBy("tree").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("long").alias("blocks"))
    queries = routed.join(blocks, "tree").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).drop("blocks")
    copies = pages.join(blocks, "tree").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    copies = copies.withColumn("block", F.col("block").cast("long"))
    return (
        copies.groupBy("tree", "block")
        .cogroup(queries.groupBy("tree", "block"))
        .applyInArrow(both, "query_id long, score long, vec_id long")
    )


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores per query, ties to the smaller id, with their rank."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products for every query.

    Queries and candidates are rows of (``vec_id``, ``vector``); a query's own id is no
    candidate, and neither are vectors of another length.
    """
    ints = stored(quantised(vectors, vec_id, vector), "vectors")
    asked = quantised(queries, vec_id, vector).withColumnRenamed("vec_id", "query_id")
    lengths = [row["d"] for row in ints.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    found = [_search(ints.where(F.size("v") == d), asked.where(F.size("v") == d), k) for d in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionAll, found)


def _search(ints: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """:func:`search` among integer vectors of one length."""
    spark = ints.sparkSession
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    norm = float(ints.agg(F.max(square)).first()[0])
    same = W.partitionBy("v").orderBy("vec_id")
    few = ints.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    entries = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = stored(entries.select("v", "ids"), "entries")
    pages, roots = build(entries, norm)
    names = roots["tree"].tolist()
    centers, radii = np.array(roots["center"].tolist()), roots["radius"].to_numpy()
    shared = spark.sparkContext.broadcast((names, centers, radii))

    def route(first_only):
        def run(batches):
            names, centers, radii = shared.value
            for batch in batches:
                v = _matrix(batch.column("v")).astype(float)
                if not len(v):
                    continue
                point = np.concatenate([v, np.zeros((len(v), 1))], axis=1)
                away = distances(point, centers)
                home = away.argmin(axis=1)
                worst = np.asarray(batch.column("worst"))
                if first_only:
                    rows, trees = np.arange(len(v)), home
                else:
                    reach = np.sqrt(np.maximum((v * v).sum(axis=1) + norm - 2.0 * worst, 0)) + slack(norm)
                    open_ = away - radii <= reach[:, None]
                    open_[np.arange(len(v)), home] = False
                    rows, trees = np.nonzero(open_)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[t] for t in trees], pa.string())] + [batch.column(c).take(at) for c in ("query_id", "v", "worst")],
                    names=["tree", "query_id", "v", "worst"],
                )

        return run

    routes = "tree string, query_id long, v array<long>, worst long"
    start = asked.withColumn("worst", F.lit(NOTHING).cast("long"))
    home = stored(_ask(pages, start.mapInArrow(route(True), routes), k, norm), "home")
    reached = home.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    known = reached.where(F.col("n") >= k).select("query_id", "low")
    again = asked.join(known, "query_id", "left").withColumn("worst", F.coalesce("low", F.lit(NOTHING).cast("long"))).drop("low")
    others = _ask(pages, again.mapInArrow(route(False), routes), k, norm)
    return best(home.unionAll(others), k).select("query_id", "rank", "vec_id", "score")
