"""Readers: corpora, saved splits, vocabularies, mappings, vectors, paired rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabbridge.functions.sequences import line_to_ids
from vocabbridge.operators.rowindex import with_row_index

# The file endings a corpus may have and the readers they stand for.
CORPUS_FORMATS = {"csv": "csv", "json": "json", "txt": "txt"}


def read_named(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or a Parquet table where ``name`` is a path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str = "text string") -> DataFrame:
    """JSON Lines with a declared schema."""
    return spark.read.schema(schema).json(path)


def read_csv(
    spark: SparkSession, path: str | list[str], schema: str | None = None, multi_line: bool = True
) -> DataFrame:
    """CSV with a header line.

    Quoted fields may span lines, which ties a file to one task; turn ``multi_line``
    off for large files without line breaks inside fields.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_paragraphs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per paragraph: the text between blank lines, empty pieces dropped."""
    rows = spark.read.option("lineSep", "\n\n").text(path)
    return rows.where(F.length("value") > 0).select(F.col("value").alias("text"))


def corpus_format(train: str | None, validation: str | None = None) -> str:
    """The format of both files: the train file's ending decides where there is one."""
    if train is None and validation is None:
        raise ValueError("a train or a validation file is needed")
    for path in (train, validation):
        if path is not None and path.rsplit(".", 1)[-1] not in CORPUS_FORMATS:
            raise ValueError(f"no corpus reader for {path}: its ending is none of {sorted(CORPUS_FORMATS)}")
    return CORPUS_FORMATS[(train or validation).rsplit(".", 1)[-1]]


def read_corpus(
    spark: SparkSession, train: str | None, validation: str | None = None
) -> dict[str, DataFrame]:
    """Corpus files by split, in the format their ending names."""
    kind = corpus_format(train, validation)
    read = {"csv": read_csv, "json": read_json_lines, "txt": read_paragraphs}[kind]
    files = {"train": train, "validation": validation}
    return {split: read(spark, path) for split, path in files.items() if path is not None}


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a saved dataset; the other splits' folders are not read."""
    return spark.read.parquet(path).where(F.col("split") == split)


def saved_splits(spark: SparkSession, path: str) -> list[str]:
    """Names of the splits of a saved dataset."""
    names = spark.read.parquet(path).select("split").distinct().orderBy("split").collect()
    return [row["split"] for row in names]


def _in_file_order(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with a sort key for their place: file, split of the file, line."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("_at"),
    )


def read_vectors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``token, ord, vector`` from lines ``token v1 .. vd``.

    A token given twice keeps its first place and its last vector.
    """
    lines = _in_file_order(spark, path).where(F.length(F.trim("value")) > 0)
    fields = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    rows = lines.select(
        F.element_at(fields, 1).alias("token"),
        F.slice(fields, 2, F.size(fields) - 1).cast("array<double>").alias("vector"),
        "_at",
    )
    unique = rows.groupBy("token").agg(
        F.max_by("vector", "_at").alias("vector"), F.min("_at").alias("_at")
    )
    return with_row_index(unique, "_at", name="ord").select("token", "ord", "vector")


def read_mapping(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``tgt_id, src_id`` from a JSON object of ids, in any layout and any number of files.

    Entries are found line by line, so a large object does not have to fit one row.  Of a
    target id given twice the last entry in file order counts.
    """
    entry = r'"(-?\d+)"\s*:\s*"?(-?\d+)"?'
    found = F.arrays_zip(
        F.regexp_extract_all("value", F.lit(entry), F.lit(1)).alias("t"),
        F.regexp_extract_all("value", F.lit(entry), F.lit(2)).alias("s"),
    )
    rows = _in_file_order(spark, path).select("_at", F.posexplode(found).alias("_pos", "_entry"))
    entries = rows.select(
        F.col("_entry.t").cast("int").alias("tgt_id"), F.col("_entry.s").cast("int").alias("src_id"), "_at", "_pos"
    )
    return entries.groupBy("tgt_id").agg(F.max_by("src_id", F.struct("_at", "_pos")).alias("src_id"))


def read_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``sample_id, src_ids, tgt_ids`` from lines of two id lists with a tab between."""
    sides = F.split("value", "\t")
    rows = _in_file_order(spark, path).select(
        line_to_ids(F.trim(sides[0])).alias("src_ids"),
        line_to_ids(F.trim(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))).alias("tgt_ids"),
        "_at",
    )
    return with_row_index(rows, "_at", name="sample_id").drop("_at")


def read_token_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``input_ids`` from lines of space-separated ids."""
    return spark.read.text(path).select(line_to_ids(F.col("value")).alias("input_ids"))


def read_vocabulary_list(spark: SparkSession, path: str | list[str], scored: bool = True) -> DataFrame:
    """``token, ord`` from a list with one token per line, the part before the tab if scored."""
    token = F.split_part("value", F.lit("\t"), F.lit(1)) if scored else F.col("value")
    rows = _in_file_order(spark, path).select(token.alias("token"), "_at")
    return with_row_index(rows, "_at", name="ord").drop("_at")


def read_tokenizer_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``token, token_id`` from the ``model.vocab`` object of a tokenizer file."""
    shape = "model struct<vocab: map<string, int>>"
    parsed = F.from_json("value", shape)["model"]["vocab"]
    return spark.read.text(path, wholetext=True).select(
        F.explode(parsed).alias("token", "token_id")
    )
