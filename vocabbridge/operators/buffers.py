"""Buffers that close with the row that fills them, over one or more epochs of a corpus.

A buffer takes rows until their lengths add up to ``limit`` or more; the row that gets
there is its last.  Where buffers begin is sequential by definition: a buffer that begins
at running length ``p`` is followed by one at the first row whose running length is at
least ``p + limit``.  Over a stretch of rows this is a function from the place where a
buffer may enter to the place where one leaves, and a short step function, since buffers
from different places soon fall into step.  Functions compose, and composition is
associative.  So stretches are summarised, ``fan`` functions at a time are composed until
one is left, entries are handed down the same tree, and the stretches number their rows.
No task sees more than ``fan`` functions or one stretch.

The function of the whole corpus says where the buffers of one epoch enter the next.  Applied
again and again it runs into a cycle, so a corpus that is repeated any number of times has
few different epochs, and only those are numbered and cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabbridge.operators.rowindex import running_before
from vocabbridge.storage import stored

# Functions that are composed in one task.
FAN = 1024
# Characters of a stretch, in buffers.
SPAN = 64

_STEPS = "node bigint, upto bigint, leave bigint, start_row bigint"
_ENTRIES = "node bigint, case int, enter bigint, open_row bigint"


@dataclass
class Steps:
    """A step function: an entry up to ``upto`` leaves at ``leave``, from ``start_row``.

    An entry beyond the last step passes by: no buffer begins here.
    """

    upto: np.ndarray
    leave: np.ndarray
    start_row: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Steps:
        rows = rows.sort_values("upto")
        return cls(*(rows[c].to_numpy(np.int64) for c in ("upto", "leave", "start_row")))

    def then(self, after: Steps) -> Steps:
        """This function and the next one as one; neighbours that leave alike are one step."""
        at = np.searchsorted(after.upto, self.leave)
        on = at < len(after.upto)
        at = np.minimum(at, len(after.upto) - 1)
        beyond = after.upto > self.upto[-1]
        upto = np.concatenate([self.upto, after.upto[beyond]])
        leave = np.concatenate([np.where(on, after.leave[at], self.leave), after.leave[beyond]])
        start = np.concatenate([np.where(on, after.start_row[at], self.start_row), after.start_row[beyond]])
        last = np.append((leave[1:] != leave[:-1]) | (start[1:] != start[:-1]), True)
        return Steps(upto[last], leave[last], start[last])

    def step(self, enter: int) -> tuple[int, int] | None:
        """Where the buffers from ``enter`` leave, and the first row of the last one."""
        at = int(np.searchsorted(self.upto, enter))
        return (int(self.leave[at]), int(self.start_row[at])) if at < len(self.upto) else None

    def rows(self, node: int) -> pd.DataFrame:
        return pd.DataFrame(
            {"node": node, "upto": self.upto, "leave": self.leave, "start_row": self.start_row}
        )


def _places(rows: DataFrame, length: str, reach: int, span: int) -> DataFrame:
    """``row_idx, pos, stretch``: running lengths, in stretches of ``span * reach``."""
    narrow = running_before(rows.select("row_idx", F.col(length).cast("bigint").alias("_len")), "row_idx", "_len", "pos")
    stretch = F.floor(F.col("pos") / (reach * span)).cast("bigint")
    return stored(narrow.select("row_idx", "pos", "_len", stretch.alias("stretch")), "stretches")


def _summaries(places: DataFrame, reach: int, span: int) -> DataFrame:
    """The step function of each stretch."""

    def summarise(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx", ignore_index=True)
        pos, rows_here = pdf["pos"].to_numpy(), pdf["row_idx"].to_numpy()
        # A buffer from before enters at most one buffer's length into the stretch.
        stop = int(np.searchsorted(pos, key[0] * reach * span + reach)) + 1
        entries = np.unique(np.searchsorted(pos, pos[: min(stop, len(pos))]))
        step = np.searchsorted(pos, pos + reach)
        last = entries.copy()
        moving = step[last] < len(pos)
        while moving.any():
            last[moving] = step[last[moving]]
            moving = step[last] < len(pos)
        ends = np.append(np.flatnonzero(np.diff(last)), len(entries) - 1)
        return Steps(pos[entries[ends]], pos[last[ends]] + reach, rows_here[last[ends]]).rows(key[0])

    return stored(places.groupBy("stretch").applyInPandas(summarise, _STEPS), "steps")


def _climb(steps: DataFrame, nodes: int, fan: int) -> list[DataFrame]:
    """The levels of the tree: each has the functions of ``fan`` nodes of the one before."""

    def merge(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [Steps.of(part) for _, part in pdf.groupby("node", sort=True)]
        return reduce(Steps.then, parts).rows(key[0])

    levels = [steps]
    while nodes > 1:
        parent = F.floor(F.col("node") / fan).cast("bigint")
        levels.append(stored(levels[-1].groupBy(parent.alias("parent")).applyInPandas(merge, _STEPS), "steps"))
        nodes = -(-nodes // fan)
    return levels


def _descend(levels: list[DataFrame], entries: DataFrame, fan: int) -> DataFrame:
    """The entries of the root handed down to the stretches: ``node, case, enter, open_row``."""

    def hand_down(key: tuple[Any, ...], left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        children = [(node, Steps.of(part)) for node, part in left.groupby("node", sort=True)]
        for row in right.itertuples():
            enter, open_row = row.enter, row.open_row
            for node, steps in children:
                out.append((node, row.case, enter, open_row))
                enter, open_row = steps.step(enter) or (enter, open_row)
        return pd.DataFrame(out, columns=["node", "case", "enter", "open_row"])

    for level in reversed(levels[:-1]):
        parent = F.floor(F.col("node") / fan).cast("bigint")
        children = level.groupBy(parent.alias("parent"))
        entries = stored(children.cogroup(entries.groupBy("node")).applyInPandas(hand_down, _ENTRIES), "entries")
    return entries


def _number(places: DataFrame, entries: DataFrame, reach: int) -> DataFrame:
    """``case, row_idx, buffer``: the first row of each row's buffer, per entry case."""

    def number(key: tuple[Any, ...], left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("row_idx", ignore_index=True)
        pos, rows_here = left["pos"].to_numpy(), left["row_idx"].to_numpy()
        parts = []
        for row in right.itertuples() if len(pos) else ():
            buffer = np.full(len(pos), row.open_row)
            at = int(np.searchsorted(pos, row.enter))
            while at < len(pos):
                after = int(np.searchsorted(pos, pos[at] + reach))
                buffer[at:after] = rows_here[at]
                at = after
            parts.append(pd.DataFrame({"case": row.case, "row_idx": rows_here, "buffer": buffer}))
        return pd.concat(parts) if parts else pd.DataFrame({"case": [], "row_idx": [], "buffer": []})

    return (
        places.groupBy("stretch")
        .cogroup(entries.groupBy("node"))
        .applyInPandas(number, "case int, row_idx bigint, buffer bigint")
    )


class Buffers:
    """The scan over one corpus: ``rows`` hold ``row_idx`` and an integer ``length`` column."""

    def __init__(self, rows: DataFrame, length: str, limit: float, span: int = SPAN, fan: int = FAN):
        # Lengths are whole, so a limit is reached when its next whole number is.
        self.reach, self.fan, self.spark = max(1, math.ceil(limit)), fan, rows.sparkSession
        self.places = _places(rows, length, self.reach, span)
        size = self.places.agg(
            F.max("stretch").alias("last"), F.max("row_idx").alias("row"),
            F.max(F.struct("row_idx", F.col("pos") + F.col("_len"))).alias("end"),
        ).first()
        self.n_rows = 0 if size["row"] is None else size["row"] + 1
        self.total = 0 if size["end"] is None else size["end"][1]
        nodes = 0 if size["last"] is None else size["last"] + 1
        self.levels = _climb(_summaries(self.places, self.reach, span), nodes, fan)

    def whole(self) -> Steps:
        """The function of one epoch.  Its entries lie in its first buffer: a bounded number of steps."""
        return Steps.of(self.levels[-1].toPandas())

    def numbered(self, entries: list[tuple[int, int]]) -> DataFrame:
        """``case, row_idx, buffer`` for each (enter, open row) at the head of the corpus."""
        rows = [(0, case, enter, open_row) for case, (enter, open_row) in enumerate(entries)]
        root = self.spark.createDataFrame(rows, _ENTRIES)
        return _number(self.places, _descend(self.levels, root, self.fan), self.reach)


def assign_buffers(rows: DataFrame, length: str, limit: float, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """Add ``buffer``: the ``row_idx`` at which the row's buffer starts."""
    numbered = Buffers(rows, length, limit, span, fan).numbered([(0, 0)])
    return rows.join(numbered.select("row_idx", "buffer"), "row_idx")


class Epochs:
    """Where buffers enter each epoch of a repeated corpus.

    ``enters`` are the different entries in order; epoch ``e`` beyond them has the entry
    of ``begin + (e - begin) % period``.
    """

    def __init__(self, steps: Steps, total: int):
        self.steps, self.total = steps, total
        self.enters, seen, enter = [], {}, 0
        while enter not in seen:
            seen[enter] = len(self.enters)
            self.enters.append(enter)
            enter = self.after(enter)
        self.begin = seen[enter]
        self.period = len(self.enters) - self.begin

    def after(self, enter: int) -> int:
        """The entry of the next epoch; a buffer that is just full leaves at 0."""
        left = self.steps.step(enter)
        return max(0, (left[0] if left else enter) - self.total)

    def enter(self, epoch: int) -> int:
        if epoch >= len(self.enters):
            epoch = self.begin + (epoch - self.begin) % self.period
        return self.enters[epoch]

    def reached(self, epoch: int, epochs: int) -> int:
        """How many of the epochs that follow give rows to the last buffer of this one."""
        place, more = self.after(self.enter(epoch)), 0
        while place > 0 and epoch + more + 1 < epochs:
            more += 1
            if self.steps.step(place):
                break
            place = max(0, place - self.total)
        return more


def repeated_buffers(
    rows: DataFrame, length: str, limit: float, epochs: int, span: int = SPAN, fan: int = FAN
) -> tuple[DataFrame, DataFrame]:
    """Buffers that run on from one epoch into the next.

    The first result holds the rows of all different epochs: ``class, place, row_idx,
    buffer``, where ``place`` orders the rows of a class and ``buffer`` is the row at which
    the buffer began.  The second one has ``epoch, class``, one row per epoch: the buffers
    that begin in the epoch are those of its class.
    """
    scan = Buffers(rows, length, limit, span, fan)
    steps = scan.whole()
    if not len(steps.upto) or scan.total == 0:  # no rows, or only rows of no length: they never fill a buffer
        cycle = None
        entries, classes, segments = [0], {}, [(0, 0, 0, False, 0)] if scan.n_rows else []
        table = [(epoch, 0) for epoch in range(epochs)]
        if segments:  # one buffer takes all epochs
            segments = [(0, epoch, 0, False, 0) for epoch in range(epochs)]
            table = [(0, 0)]
    else:
        cycle = Epochs(steps, scan.total)
        entries, classes, segments, table = cycle.enters, {}, [], []
    for epoch in range(epochs if cycle else 0):
        enter, more = cycle.enter(epoch), cycle.reached(epoch, epochs)
        if (enter, more) not in classes:
            name = classes[enter, more] = len(classes)
            found = steps.step(enter)
            if found:
                segments.append((name, 0, entries.index(enter), False, 0))
                for step in range(1, more + 1):
                    segments.append((name, step, entries.index(cycle.enter(epoch + step)), True, found[1]))
        table.append((epoch, classes[enter, more]))
    spark = rows.sparkSession
    parts = spark.createDataFrame(segments, "class int, step int, case int, carried boolean, open_row bigint")
    numbered = scan.numbered([(enter, -1) for enter in entries])
    # One row per different epoch and epoch that its last buffer runs into: far fewer than rows.
    placed = numbered.join(F.broadcast(parts), "case").where((F.col("buffer") < 0) == F.col("carried"))
    shown = placed.select(
        "class",
        (F.col("step").cast("bigint") * scan.n_rows + F.col("row_idx")).alias("place"),
        "row_idx",
        F.when(F.col("carried"), F.col("open_row")).otherwise(F.col("buffer")).alias("buffer"),
    )
    return shown, spark.createDataFrame(table, "epoch int, class int")
