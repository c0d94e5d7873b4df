"""Times the stages on one machine and prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of cores.  Each
stage is run once, in order, and reads what the stages before it wrote.  A run over
the smallest tables, not timed, loads classes and Python workers first.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vocabbridge.catalog import alignment, common, corpus, evaluation, model, packing, tokens, vectors  # noqa: E402
from vocabbridge.plans import stages  # noqa: E402
from vocabbridge.storage import stored  # noqa: E402


def drain(df) -> None:
    """Compute every row and column of ``df`` without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def stage_runs(spark, folder) -> dict:
    """Stage name to a function that returns its result."""

    def fit(passes, schedule):
        side = common.target(spark, folder)
        pairs = common.stage(
            spark, folder, "cooc", lambda: stored(stages.count_pairs(side, vectors.WINDOW), "cooc")
        )
        ids = stages.vector_vocabulary(side.vocab)
        params = vectors.G.fit(pairs, ids, dims=32, passes=passes, schedule=schedule)
        return vectors.G.final_vectors(params)

    return {
        "prepare_corpus": lambda: common.prepared(spark, folder),
        "tokenise_source": lambda: common.source(spark, folder).rows,
        "tokenise_target": lambda: common.target(spark, folder).rows,
        "token_budget_cut": lambda: corpus.token_budget_cut(spark, folder),
        "tokenise_joined": lambda: tokens.tokenise_joined(spark, folder),
        "tokenise_library": lambda: tokens.tokenise_library(spark, folder),
        "vocabulary_overlap": lambda: common.overlap(spark, folder),
        "overlap_score": lambda: evaluation.overlap_score(spark, folder),
        "packed_blocks": lambda: packing.packed_blocks(spark, folder),
        "buffered_blocks": lambda: packing.buffered_blocks(spark, folder),
        "cooccurrence_window_5": lambda: stages.count_pairs(common.target(spark, folder), vectors.WINDOW),
        "cooccurrence_window_15": lambda: stages.count_pairs(common.target(spark, folder)),
        "fit_three_passes": lambda: fit(3, "batch"),
        "fit_strata_pass": lambda: fit(1, "strata"),
        "nearest_vanilla": lambda: alignment.nearest_vanilla(spark, folder),
        "alignment_relative": lambda: alignment.alignment_relative(spark, folder),
        "rearranged_rows": lambda: model.rearranged_rows(spark, folder),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()

    only = sys.argv[1:]
    small = str(Path(folder).parent / "sf0.001")
    if Path(small).exists():
        for name, run in stage_runs(spark, small).items():
            if not only or name in only:
                drain(run())
    runs = stage_runs(spark, folder)
    seconds = {}
    for name, run in runs.items():
        if only and name not in only:
            continue
        begin = time.perf_counter()
        drain(run())
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total stage time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
