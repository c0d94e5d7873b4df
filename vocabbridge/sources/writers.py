"""Writers for what the stages hand on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabbridge.functions.sequences import ids_to_line
from vocabbridge.functions.vectors import to_text


def write_json_lines(df: DataFrame, path: str) -> None:
    """One ``{"text": ...}`` object per line, UTF-8."""
    df.select("text").write.json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """All splits of a dataset, one folder each."""
    df.write.partitionBy("split").parquet(path)


def write_token_lines(lines: DataFrame, path: str) -> None:
    """One line of ids per row."""
    lines.select("line").write.text(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Lines of source ids, a tab, and target ids, in sample order."""
    line = F.concat_ws("\t", ids_to_line(F.col("src_ids")), ids_to_line(F.col("tgt_ids")))
    pairs.orderBy("sample_id").select(line.alias("value")).write.text(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """A mapping as Parquet, the form the later stages read."""
    mapping.write.parquet(path)


def write_mapping_json(mapping: DataFrame, path: str) -> None:
    """A mapping as one tab-indented JSON object, spread over ordered part files.

    The parts in name order make up the object; ``read_mapping`` reads the folder.
    """
    entries = mapping.select(
        F.col("tgt_id").cast("bigint").alias("tgt_id"), F.col("src_id").cast("bigint").alias("src_id")
    )
    last = entries.agg(F.max("tgt_id")).scalar()
    comma = F.when(F.col("tgt_id") == last, "").otherwise(",")
    line = F.concat(F.lit('\t"'), "tgt_id", F.lit('": '), "src_id", comma)
    first = F.when(F.col("tgt_id") == entries.agg(F.min("tgt_id")).scalar(), "{\n").otherwise("")
    end = F.when(F.col("tgt_id") == last, "\n}").otherwise("")
    entries.orderBy("tgt_id").select(F.concat(first, line, end).alias("value")).write.text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Lines ``token v1 .. vd`` in vector order."""
    line = F.concat_ws(" ", "token", to_text(F.col("vector")))
    vectors.orderBy("ord").select(line.alias("value")).write.text(path)


def write_matrices(model: DataFrame, path: str) -> None:
    """Rearranged embedding tables, one folder per matrix."""
    model.write.partitionBy("matrix").parquet(path)
