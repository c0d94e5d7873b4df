"""Round trips: a table is written in one of the exchanged forms and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocabbridge.catalog.common import (
    BOTH, CORPUS, OVERLAP, PAIRS, SRC, TGT, overlap, pairs, plain, prepared, source, table, target,
)
from vocabbridge.functions.sequences import ids_to_line
from vocabbridge.operators import export as X
from vocabbridge.operators.rearrange import gather
from vocabbridge.sources import readers as R
from vocabbridge.sources import writers as W
from vocabbridge.storage import new_path


def named_table_scan(spark, folder):
    return R.read_named(spark, f"{folder}/documents.parquet").select("doc_id", "lang", "n_chars")


def json_lines(spark, folder):
    path = new_path(spark, "jsonl") + ".json"
    W.write_json_lines(prepared(spark, folder), path)
    back = R.read_corpus(spark, path)["train"]
    return plain(back.groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n_rows")))


def csv_corpus(spark, folder):
    path = new_path(spark, "csv") + ".csv"
    prepared(spark, folder).select("text").write.option("header", True).option("escape", '"').csv(path)
    back = R.read_corpus(spark, path)["train"]
    return plain(back.groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n_rows")))


def paragraphs(spark, folder):
    path = new_path(spark, "text") + ".txt"
    prepared(spark, folder).select("text").write.option("lineSep", "\n\n").text(path)
    back = R.read_corpus(spark, path)["train"]
    return plain(back.groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n_rows")))


def saved_splits(spark, folder):
    path = new_path(spark, "splits")
    W.write_splits(target(spark, folder).rows, path)
    validation = R.read_split(spark, path, "validation")
    return plain(validation.select("row_idx", F.size("input_ids").alias("n_ids")))


def split_names(spark, folder):
    path = new_path(spark, "splits")
    W.write_splits(target(spark, folder).rows.select("split", "row_idx"), path)
    names = R.saved_splits(spark, path)
    from vocabbridge.operators.corpus import evaluation_split

    return (
        spark.read.parquet(path)
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("chosen", F.col("split") == evaluation_split(names))
    )


def token_line_file(spark, folder):
    path = new_path(spark, "lines")
    train = source(spark, folder).rows.where(F.col("split") == "train")
    W.write_token_lines(X.token_lines(train, X.MIN_TOKENS_TRAIN), path)
    back = R.read_token_lines(spark, path)
    lines = back.select(F.md5(ids_to_line(F.col("input_ids"))).alias("line_md5"))
    return lines.groupBy("line_md5").agg(F.count(F.lit(1)).alias("n_rows"))


def pair_file(spark, folder):
    path = new_path(spark, "pairs")
    W.write_pairs(pairs(spark, folder), path)
    back = R.read_pairs(spark, path)
    return plain(
        back.select(
            F.col("sample_id").alias("line"),
            F.md5(ids_to_line(F.col("src_ids"))).alias("src_md5"),
            F.md5(ids_to_line(F.col("tgt_ids"))).alias("tgt_md5"),
        )
    )


def mapping_file(spark, folder):
    path = new_path(spark, "mapping")
    W.write_mapping_json(overlap(spark, folder), path)
    return plain(R.read_mapping(spark, path))


def mapping_table(spark, folder):
    path = new_path(spark, "mapping")
    W.write_mapping(overlap(spark, folder), path)
    return plain(R.read_named(spark, path))


def vector_file(spark, folder):
    path = new_path(spark, "vectors")
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("token"),
        F.col("vec_id").alias("ord"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    W.write_vectors(vectors, path)
    back = R.read_vectors(spark, path)
    return plain(back.select("token", "ord", F.posexplode("vector").alias("d", "value")))


def vocabulary_list(spark, folder):
    """A scored list: token, tab, count, in id order."""
    path = new_path(spark, "list")
    line = F.concat_ws("\t", "token", F.col("cnt").cast("string"))
    source(spark, folder).vocab.orderBy("token_id").select(line.alias("value")).write.text(path)
    return plain(R.read_vocabulary_list(spark, path))


def matrix_tables(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        F.lit("embed").alias("matrix"), F.col("vec_id").alias("token_id"), F.col("embedding").alias("vector")
    )
    identity = rows.select(F.col("token_id").alias("tgt_id"), F.col("token_id").alias("src_id"))
    path = new_path(spark, "model")
    W.write_matrices(gather(identity, rows), path)
    back = spark.read.parquet(path)
    return plain(back.select("matrix", "token_id", F.size("vector").alias("dims")))


QUERIES = {
    f.__name__: f
    for f in (
        named_table_scan, json_lines, csv_corpus, paragraphs, saved_splits, split_names,
        token_line_file, pair_file, mapping_file, mapping_table, vector_file, vocabulary_list,
        matrix_tables,
    )
}

_TEXTS = f"WITH {CORPUS} SELECT md5(text) AS text_md5, count(*) AS n_rows FROM kept GROUP BY 1"
_LINE = "md5(string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY pos))"

SQL = {
    "named_table_scan": "SELECT doc_id, lang, n_chars FROM documents",
    "json_lines": _TEXTS,
    "csv_corpus": _TEXTS,
    "paragraphs": f"""WITH {CORPUS}, pieces AS (SELECT unnest(string_split(text || chr(10) || chr(10), chr(10) || chr(10))) AS text FROM kept)
        SELECT md5(text) AS text_md5, count(*) AS n_rows FROM pieces WHERE text <> '' GROUP BY 1""",
    "saved_splits": f"""WITH {CORPUS},{TGT} SELECT row_idx, count(*) AS n_ids FROM tgt_tok
        WHERE split = 'validation' GROUP BY row_idx""",
    "split_names": f"""WITH {CORPUS} SELECT split, count(*) AS n_rows, split = 'validation' AS chosen
        FROM corpus GROUP BY split""",
    "token_line_file": f"""WITH {CORPUS},{SRC},
        l AS (SELECT row_idx, {_LINE} AS line_md5 FROM src_tok WHERE split = 'train' GROUP BY row_idx)
        SELECT line_md5, count(*) AS n_rows FROM l GROUP BY line_md5""",
    "pair_file": f"""WITH {BOTH},{PAIRS},
        s AS (SELECT row_idx, {_LINE} AS src_md5 FROM src_tok GROUP BY row_idx),
        t AS (SELECT row_idx, {_LINE} AS tgt_md5 FROM tgt_tok GROUP BY row_idx)
        SELECT row_number() OVER (ORDER BY sample_id) - 1 AS line, src_md5, tgt_md5
        FROM samples JOIN s USING (row_idx) JOIN t USING (row_idx)""",
    "mapping_file": f"WITH {BOTH},{OVERLAP} SELECT tgt_id, src_id FROM overlap",
    "mapping_table": f"WITH {BOTH},{OVERLAP} SELECT tgt_id, src_id FROM overlap",
    "vector_file": """SELECT CAST(vec_id AS VARCHAR) AS token, vec_id AS ord, unnest(range(len(embedding))) AS d,
        round(unnest(CAST(embedding AS DOUBLE[])), 6) AS value FROM embeddings""",
    "vocabulary_list": f"WITH {CORPUS},{SRC} SELECT token, token_id AS ord FROM src_vocab",
    "matrix_tables": "SELECT 'embed' AS matrix, vec_id AS token_id, len(embedding) AS dims FROM embeddings",
}
