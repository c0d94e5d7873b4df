"""Where intermediate tables live.

Stage outputs that several later steps read (row-indexed corpora, tokenised
corpora, counts, fitted vectors) are written once as Parquet to the folder the
cluster shares and read back.  That cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# For texts and ids, which shrink by a third more than with the default codec.
SMALL = "zstd"

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    return _LOCAL_DIRS[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/vocabbridge/{label}-{uuid.uuid4().hex}"


def stored(
    df: DataFrame, label: str = "table", partition_by: list[str] | None = None, compression: str | None = None
) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, partitionBy=partition_by, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
