import json

import pytest

from vocabbridge.sources import readers as R
from vocabbridge.sources import writers as W
from vocabbridge.storage import new_path, shared_dir


def test_format_follows_the_train_file():
    assert R.corpus_format("a/b.json") == "json"
    assert R.corpus_format("a.csv", "b.txt") == "csv"
    assert R.corpus_format(None, "b.txt") == "txt"
    for files in (("a.parquet",), ("a.json", "b.xml"), (None, None)):
        with pytest.raises(ValueError):
            R.corpus_format(*files)


def test_corpus_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"text": "añ"}\n{"text": "b"}\n')
    (tmp_path / "v.json").write_text('{"text": "c"}\n')
    splits = R.read_corpus(spark, str(tmp_path / "t.json"), str(tmp_path / "v.json"))
    assert {s: d.count() for s, d in splits.items()} == {"train": 2, "validation": 1}
    (tmp_path / "t.csv").write_text('text,n\n"a, ""q""\nb",1\nc,2\n')
    rows = R.read_corpus(spark, str(tmp_path / "t.csv"))["train"].collect()
    assert [r.text for r in rows] == ['a, "q"\nb', "c"]


def test_paragraphs_drop_empty_pieces_only(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a\nb\n\nc\n\n\n\nd\n\n\ne\n")
    got = [r.text for r in R.read_paragraphs(spark, str(tmp_path / "p.txt")).collect()]
    assert got == [p for p in "a\nb\n\nc\n\n\n\nd\n\n\ne\n".split("\n\n") if p]


def test_mapping_in_any_layout(spark, tmp_path):
    data = {"3": 4, "0": 12, "7": 0}
    (tmp_path / "tab.json").write_text(json.dumps(data, indent="\t"))
    (tmp_path / "one.json").write_text(json.dumps(data))
    for name in ("tab.json", "one.json"):
        got = {(r.tgt_id, r.src_id) for r in R.read_mapping(spark, str(tmp_path / name)).collect()}
        assert got == {(3, 4), (0, 12), (7, 0)}


def test_last_entry_of_a_target_id_counts(spark, tmp_path):
    (tmp_path / "twice.json").write_text('{"3": 4, "0": 1, "3": 5,\n"0": 2,\n"7": 9, "0": 8}')
    got = {(r.tgt_id, r.src_id) for r in R.read_mapping(spark, str(tmp_path / "twice.json")).collect()}
    assert got == {(3, 5), (0, 8), (7, 9)}


def test_written_mapping_is_one_json_object(spark, tmp_path):
    mapping = spark.range(100).selectExpr("cast(id as int) tgt_id", "cast(99 - id as int) src_id").repartition(5)
    W.write_mapping_json(mapping, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert json.loads(text) == {str(n): 99 - n for n in range(100)}
    assert text.startswith('{\n\t"0": 99,\n')


def test_vectors_keep_first_place_and_last_value(spark, tmp_path):
    (tmp_path / "v.txt").write_text("5 1.0 2.0\n<unk> 0 0\n5 3.5 -4\n9 1e-3 2\n")
    got = R.read_vectors(spark, str(tmp_path / "v.txt")).orderBy("ord").collect()
    assert [(r.token, r.ord, r.vector) for r in got] == [
        ("5", 0, [3.5, -4.0]), ("<unk>", 1, [0.0, 0.0]), ("9", 2, [0.001, 2.0]),
    ]
    W.write_vectors(R.read_vectors(spark, str(tmp_path / "v.txt")), str(tmp_path / "out"))
    again = R.read_vectors(spark, str(tmp_path / "out")).orderBy("ord").collect()
    assert [r.vector for r in again] == [r.vector for r in got]


def test_pairs_with_an_empty_side(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("1 2\t3\n\t4 5\n6\t\n")
    got = R.read_pairs(spark, str(tmp_path / "p.tsv")).orderBy("sample_id").collect()
    assert [(r.src_ids, r.tgt_ids) for r in got] == [([1, 2], [3]), ([], [4, 5]), ([6], [])]


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "scored.txt").write_text("b\t-1.5\na\t-2\n")
    (tmp_path / "plain.txt").write_text("b\na x\n")
    scored = R.read_vocabulary_list(spark, str(tmp_path / "scored.txt")).orderBy("ord").collect()
    assert [r.token for r in scored] == ["b", "a"]
    plain = R.read_vocabulary_list(spark, str(tmp_path / "plain.txt"), scored=False).orderBy("ord").collect()
    assert [r.token for r in plain] == ["b", "a x"]
    tokenizer = {"version": "1", "model": {"type": "BPE", "vocab": {"a": 0, 'q"é': 1}, "merges": []}}
    (tmp_path / "tokenizer.json").write_text(json.dumps(tokenizer, indent=2))
    got = R.read_tokenizer_vocabulary(spark, str(tmp_path / "tokenizer.json")).collect()
    assert {(r.token, r.token_id) for r in got} == {("a", 0), ('q"é', 1)}


def test_saved_splits_prune_folders(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("validation", 2), ("train", 3)], "split string, n int")
    W.write_splits(df, str(tmp_path / "d"))
    assert R.saved_splits(spark, str(tmp_path / "d")) == ["train", "validation"]
    train = R.read_split(spark, str(tmp_path / "d"), "train")
    assert {r.n for r in train.collect()} == {1, 3}
    assert {r.f.rsplit("/", 2)[1] for r in train.selectExpr("input_file_name() f").collect()} == {"split=train"}
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().toString()


def test_named_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert R.read_named(spark, str(tmp_path / "t")).count() == 3
    spark.range(4).createOrReplaceTempView("four")
    assert R.read_named(spark, "four").count() == 4


def test_paths_are_new_and_shared(spark):
    assert new_path(spark, "x") != new_path(spark, "x")
    assert new_path(spark, "x").startswith(shared_dir(spark))
