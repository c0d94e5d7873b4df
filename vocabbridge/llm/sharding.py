"""Sharding by bytes: minimax contiguous partition of groups of equal texts.

Groups are atomic and ordered by their smallest ``doc_id``.  The smallest capacity for
which the ordered groups fit into the shards is found by binary search with a greedy
check; the order is then cut as evenly as that capacity allows.  A group larger than a fair
share of what the others leave has a shard of its own (fewer than ``shards`` groups can
be so large), which keeps the other shards equal.

The check needs prefix sums only.  The driver holds a bounded number of them (knots):
first coarse ones, then finer ones in the windows where a cut can still fall, until no
prefix sum in a window is missing.  The result is that of a search over all of them.

Nulls and edges: a null text has no bytes and equals an empty one.  A null ``doc_id``
sorts first.  Repeated rows are rows of one group.  No documents give no rows; fewer
groups than shards leave shards empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabbridge.llm.ordered import running
from vocabbridge.storage import stored

# Prefix sums that the driver asks for in each window and step.
KNOTS = 4096


class Prefixes:
    """Known prefix sums of the ordered groups.

    ``ends`` are some of the prefix sums, the last one included; ``closed[i]`` says that
    there is no other between ``ends[i - 1]`` and ``ends[i]``.
    """

    def __init__(self, ends: np.ndarray, closed: np.ndarray):
        self.ends, self.closed = ends, closed

    def cuts(self, capacity: int, parts: int, most: bool) -> list[int]:
        """Where a greedy fill ends each part: at least (or at ``most``) so far."""
        at, out, total = 0, [], int(self.ends[-1])
        for _ in range(parts):
            reach = min(at + capacity, total)
            i = int(np.searchsorted(self.ends, reach, side="right"))
            known = int(self.ends[i - 1]) if i else 0
            if most and i < len(self.ends) and not self.closed[i]:
                known = reach
            at = max(at, known)
            out.append(at)
        return out

    def smallest(self, parts: int, most: bool) -> int:
        """The smallest capacity with which a greedy fill reaches the end."""
        total = int(self.ends[-1])
        low, high = -(-total // parts), total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, parts, most)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low

    def even_cuts(self, capacity: int, parts: int) -> list[int]:
        """Cuts as even as the known prefix sums allow, no part above ``capacity``."""
        at, out, total = 0, [], int(self.ends[-1])
        for left in range(parts, 1, -1):
            last = int(np.searchsorted(self.ends, at + capacity, side="right")) - 1
            ideal = at + (total - at) // left
            low = int(np.searchsorted(self.ends, ideal, side="right"))
            if low and (low == len(self.ends) or ideal - self.ends[low - 1] <= self.ends[low] - ideal):
                low -= 1
            while low < last:  # the first cut from there on whose rest still fits
                middle = (low + last) // 2
                if self._fits(int(self.ends[middle]), capacity, left - 1):
                    last = middle
                else:
                    low = middle + 1
            at = max(at, int(self.ends[last])) if last >= 0 else at
            out.append(at)
        return [*out, total]

    def _fits(self, at: int, capacity: int, parts: int) -> bool:
        for _ in range(parts):
            i = int(np.searchsorted(self.ends, at + capacity, side="right"))
            at = max(at, int(self.ends[i - 1]) if i else 0)
        return at >= int(self.ends[-1])

    def open_windows(self, low: list[int], high: list[int]) -> list[tuple[int, int]]:
        """Knot to knot ranges around the possible cuts in which prefix sums are missing."""
        found: list[tuple[int, int]] = []
        for a, b in zip(low, high, strict=True):
            i = int(np.searchsorted(self.ends, a, side="right")) - 1
            j = int(np.searchsorted(self.ends, b, side="left"))
            j = min(max(j, i + 1), len(self.ends) - 1)
            while i + 1 <= j and self.closed[i + 1]:
                i += 1
            while j > i and self.closed[j]:
                j -= 1
            if j <= i:
                continue
            window = (int(self.ends[i]) if i >= 0 else 0, int(self.ends[j]))
            if found and window[0] < found[-1][1]:
                found[-1] = (found[-1][0], max(found[-1][1], window[1]))
            else:
                found.append(window)
        return found

    def refined(self, windows: list[tuple[int, int]], ends: np.ndarray, closed: np.ndarray) -> Prefixes:
        keep = np.ones(len(self.ends), bool)
        for a, b in windows:
            keep &= ~((self.ends > a) & (self.ends <= b))
        ends = np.concatenate([self.ends[keep], ends])
        closed = np.concatenate([self.closed[keep], closed])
        order = np.argsort(ends)
        return Prefixes(ends[order], closed[order])


def _knots(
    prefixes: DataFrame, windows: list[tuple[int, int]], knots: int
) -> tuple[np.ndarray, np.ndarray]:
    """The last prefix sum in each of ``knots`` equal pieces of each window."""
    piece: Column = F.lit(None).cast("long")
    for number, (a, b) in enumerate(windows):
        inside = (F.col("end") > a) & (F.col("end") <= b)
        step = max(1, -(-(b - a) // knots))
        piece = F.when(inside, F.lit(number * (knots + 1)) + F.expr(f"(end - {a + 1}) div {step}")).otherwise(piece)
    found = (
        prefixes.select("end", piece.alias("piece"))
        .where(F.col("piece").isNotNull())
        .groupBy("piece")
        .agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
        .toPandas()
        .sort_values("end")
    )
    return found["end"].to_numpy(np.int64), found["n"].to_numpy() == 1


def minimax_cuts(prefixes: DataFrame, total: int, parts: int) -> list[int]:
    """The prefix sums (column ``end``) that end each of ``parts`` parts, smallest capacity.

    Of the cuts with that capacity the most even ones are taken, so the last part is not
    what a greedy fill leaves over.
    """
    known, windows, knots = Prefixes(np.array([total]), np.array([False])), [(0, total)], KNOTS

    def look(windows, known, knots):
        return known.refined(windows, *_knots(prefixes, windows, knots))

    while windows:
        known, before = look(windows, known, knots), windows
        low, high = known.smallest(parts, True), known.smallest(parts, False)
        windows = known.open_windows(known.cuts(low, parts, False), known.cuts(high, parts, True))
        knots = finer(knots, before, windows)
    capacity = known.smallest(parts, False)
    while True:
        cuts = known.even_cuts(capacity, parts)
        around = [np.searchsorted(known.ends, c) for c in cuts[:-1]]
        windows = known.open_windows(
            [int(known.ends[i - 1]) if i else 0 for i in around],
            [int(known.ends[min(i + 1, len(known.ends) - 1)]) for i in around],
        )
        if not windows:
            return cuts
        knots = finer(knots, before, windows)
        known, before = look(windows, known, knots), windows


def finer(knots: int, before: list[tuple[int, int]], windows: list[tuple[int, int]]) -> int:
    """Twice the knots unless the widest window has at least halved.

    What is not known of one cut adds up over the cuts before it, so the windows of
    neighbouring cuts grow together until there are about as many knots as the square of
    the parts.  Either way the widest piece halves in every round, so the search ends, when
    every group has a piece of its own at the latest.
    """
    widest = [max((b - a for a, b in w), default=0) for w in (before, windows)]
    return knots * 2 if widest[1] * 2 > widest[0] else knots


def _own_shards(groups: DataFrame, total: int, shards: int) -> list[tuple[bytes, int]]:
    """Key and bytes of the groups that are larger than a fair share of the rest."""
    largest = groups.orderBy(F.desc("bytes"), "key").limit(shards).select("key", "bytes").collect()
    own, left = [], total
    for row in largest:
        if row["bytes"] * (shards - len(own)) <= left:
            break
        own.append((bytes(row["key"]), row["bytes"]))
        left -= row["bytes"]
    return own[: shards - 1]


def assign_shards(
    docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus 8; ``slot`` counts the rows of a shard from 0.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(body).cast("long") + 8
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(body).alias("text_crc32"),
            F.unhex(F.sha2(body, 256)).alias("key"),
        ),
        "sizes",
    )
    groups = stored(
        rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes")), "groups"
    )
    total = groups.agg(F.sum("bytes")).first()[0]
    if total is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    own = _own_shards(groups, total, shards)
    spark = docs.sparkSession
    own_rows = spark.createDataFrame([(k, i) for i, (k, _) in enumerate(own)], "key binary, shard int")
    others = groups.join(F.broadcast(own_rows), "key", "left_anti")
    rest = total - sum(b for _, b in own)
    ordered = running(others, ["first", "key"], {"before": "bytes"})
    shard = F.lit(len(own))
    if rest:
        cuts = minimax_cuts(ordered.select((F.col("before") + F.col("bytes")).alias("end")), rest, shards - len(own))
        for cut in cuts[:-1]:
            shard = shard + (F.col("before") >= cut).cast("int")
    placed = ordered.select("key", shard.alias("shard")).unionAll(own_rows)
    sharded = rows.join(placed, "key").select("doc_id", "size", "text_crc32", "key", "shard", F.lit(1).alias("one"))
    numbered = stored(running(sharded, ["shard", "doc_id", "key"], {"place": "one"}), "places")
    starts = numbered.groupBy("shard").agg(F.min("place").alias("start"))
    return numbered.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("start")).alias("slot")
    )
