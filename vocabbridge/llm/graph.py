"""Connected components by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabbridge.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, comp``: the smallest node that each node of ``edges`` (a, b) is connected to.

    Each round takes the smallest label among the neighbours and then the label of that
    label, and is written; rounds go on until no label changes.  Only counts reach the
    driver.
    """
    both = stored(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .distinct(),
        "edges",
    )
    labels = stored(
        both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("comp")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), "comp"), "other")
            .groupBy("node")
            .agg(F.min("comp").alias("_near"))
        )
        lower = labels.join(near, "node").select("node", F.col("comp").alias("_old"), F.least("comp", "_near").alias("comp"))
        onward = lower.select(F.col("node").alias("comp"), F.col("comp").alias("_next"))
        jumped = lower.join(onward, "comp", "left").select(
            "node", F.least("comp", F.coalesce("_next", "comp")).alias("comp"), "_old"
        )
        after = stored(jumped, "labels")
        if not after.where("comp <> _old").limit(1).count():
            return after.select("node", "comp")
        labels = after.select("node", "comp")
