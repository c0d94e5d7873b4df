import random
import re

import pytest
from pyspark.sql import functions as F

from vocabbridge.functions.sequences import ids_to_line, line_to_ids
from vocabbridge.functions.text import WORDS, WORDS_AND_MARKS, cut_pattern, words, words_and_added
from vocabbridge.operators import export as X
from vocabbridge.operators import tokenise as K
from vocabbridge.operators import vocabulary as V
from vocabbridge.operators import lookup
from vocabbridge.operators.lookup import lookup_ids, lookup_join, lookup_values, table_bytes


@pytest.fixture
def rows(spark):
    data = [(0, "b a b"), (1, "c  b\nd"), (2, ""), (3, "a")]
    return spark.createDataFrame(data, "row_idx bigint, text string")


@pytest.fixture
def vocab(spark):
    return spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "token string, token_id int")


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize(
    ("unknown", "expected"),
    [(None, [[0, 1, 0], [2, 0], [], [1]]), (9, [[0, 1, 0], [2, 0, 9], [], [1]])],
)
def test_tokenise_both_ways(spark, rows, vocab, limit, unknown, expected):
    got = K.tokenise(rows, vocab, WORDS, unknown, limit_bytes=limit).orderBy("row_idx").collect()
    assert [r.input_ids for r in got] == expected
    assert [r.attention_mask for r in got] == [[True] * len(e) for e in expected]


@pytest.mark.parametrize(
    ("tokens", "text", "expected"),
    [
        (["ab", "abc", "bcd"], "xabcd y", ["x", "abc", "d", "y"]),
        (["ab", "bcd"], "abcd", ["ab", "cd"]),
        (["a b", "b"], "xa b bb", ["x", "a b", "b", "b"]),
        (["<s>", "s", "."], "<s>see. s", ["<s>", "s", "ee", ".", "s"]),
        (["é", "日本", "日"], "é日本日x", ["é", "日本", "日", "x"]),
        (["abcx"], "ab abc abcabcx", ["ab", "abc", "abc", "abcx"]),
        (["a"], "", []),
        (["\n", "\\d"], "q\nr\\d1", ["q", "\n", "r", "\\d", "1"]),
        ([], "a  b", ["a", "b"]),
    ],
)
def test_added_tokens_are_cut_out_first(spark, tokens, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(words_and_added(F.col("text"), WORDS, tokens)).first()[0] == expected


def test_cut_pattern_is_leftmost_longest():
    draw = random.Random(6)
    for _ in range(300):
        tokens = {"".join(draw.choice("ab.") for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(1, 6))}
        text = "".join(draw.choice("ab.c") for _ in range(30))
        at, expected = 0, []
        while at < len(text):
            here = max((t for t in tokens if text.startswith(t, at)), key=len, default=None)
            if here:
                expected.append(here)
            at += len(here or "x")
        assert re.findall(cut_pattern(sorted(tokens)), text) == expected
    with pytest.raises(ValueError, match="empty"):
        cut_pattern([""])


def test_added_tokens_are_measured(spark, vocab):
    new = spark.createDataFrame([("zz", 0), ("a", 1), ("y", 2), ("zz", 3)], "token string, ord int")
    extended = V.extend_vocabulary(vocab, new, "ord")
    assert V.added_tokens(extended) == ["zz", "y"]
    with pytest.raises(ValueError, match="bytes of added"):
        V.added_tokens(extended, 2)


def test_special_tokens_and_types(spark, rows, vocab):
    got = K.tokenise(rows, vocab, WORDS, bos=7, eos=8)
    assert got.schema["input_ids"].dataType.simpleString() == "array<int>"
    assert got.schema["attention_mask"].dataType.simpleString() == "array<boolean>"
    assert got.where("row_idx = 2").first().input_ids == [7, 8]
    assert "text" not in got.columns


def test_text_column_choice(spark):
    assert K.text_column(spark.createDataFrame([("x", "y")], "a string, text string")) == "text"
    assert K.text_column(spark.createDataFrame([("x", "y")], "a string, b string")) == "a"


def test_marks_are_tokens_of_their_own(spark):
    df = spark.createDataFrame([("añb_c, 12!",)], "text string")
    assert df.select(words(F.col("text"), WORDS_AND_MARKS)).first()[0] == ["añb", "_", "c", ",", "12", "!"]


def test_library_tokeniser_loads_per_worker(spark, rows):
    def load():
        return lambda texts: [[len(w) for w in t.split()] for t in texts]

    encode = K.library_tokeniser(load)
    got = rows.select("row_idx", encode("text").alias("ids")).orderBy("row_idx").collect()
    assert [r.ids for r in got] == [[1, 1, 1], [1, 1, 1], [], [1]]


def test_heavy_keys_are_dealt_out(spark):
    facts = spark.range(500).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"), "id")
    dim = spark.range(450).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = lookup_join(facts, dim, "k", ["id"])
    large = lookup_join(facts, dim, "k", ["id"], limit_bytes=0, rows_per_copy=50)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert large.count() == 500
    inner = lookup_join(facts, dim, "k", ["id"], "inner", limit_bytes=0, rows_per_copy=50)
    assert inner.count() == 450


def test_lookup_of_ids_with_nulls_kept_in_place(spark):
    rows = [(0, [5, 6, None, 5]), (1, []), (2, [8]), (3, None), (4, [None]), (5, [6]), (5, [8, 9])]
    df = spark.createDataFrame(rows, "row_idx bigint, ids array<int>")
    # A double key takes its smallest value; null keys and values are no entries.
    mapping = spark.createDataFrame([(5, 50), (8, 81), (8, 80), (None, 7), (9, None)], "k int, v int")
    for missing, expected in (
        (-1, [[50, -1, -1, 50], [], [80], [], [-1], [-1], [80, -1]]),
        (None, [[50, 50], [], [80], [], [], [], [80]]),
    ):
        for limit in (1 << 20, 0):
            got = lookup_ids(df, F.col("ids"), mapping, "out", missing, limit_bytes=limit).orderBy("row_idx", F.size("out"))
            assert sorted((r.row_idx, r.out) for r in got.collect()) == sorted(
                (k, o) for (k, _), o in zip(rows, expected, strict=True)
            )


def test_lookup_in_many_buckets(spark):
    df = spark.range(300).select(
        F.col("id").alias("row_idx"),
        F.transform(F.sequence(F.lit(0), F.col("id") % 7), lambda i: F.concat(F.lit("w"), (i * 31 + F.col("id")) % 50)).alias("w"),
        F.lit("kept").alias("other"),
    )
    vocab = spark.range(45).select(F.concat(F.lit("w"), F.col("id")).alias("t"), F.col("id").alias("n"))
    small = lookup_values(df, F.col("w"), vocab, "ids")
    large = lookup_values(df, F.col("w"), vocab, "ids", limit_bytes=0, bucket_items=40)
    assert small.columns == large.columns == ["row_idx", "w", "other", "ids"]
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    none = lookup_values(df.where("row_idx < 0"), F.col("w"), vocab, "ids", limit_bytes=0)
    assert none.count() == 0
    plan = large._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    # Rows travel by bucket; what travels by element are sets of buckets, one per element and task.
    assert "hashpartitioning(_key" in plan and "collect_set" in plan and "posexplode" not in plan


def test_rows_without_ids_are_decoded(spark, vocab):
    df = spark.createDataFrame([(0, [0, 9, 1]), (1, []), (2, None)], "row_idx bigint, input_ids array<int>")
    for limit in (1 << 20, 0):
        got = K.decode(df, vocab, limit_bytes=limit).orderBy("row_idx").collect()
        assert [r.decoded for r in got] == ["b 9 a", "", ""]


def test_table_bytes_grows_with_rows(spark):
    small = spark.createDataFrame([("a", 1)], "t string, n int")
    assert 0 < table_bytes(small) < table_bytes(small.union(small))


def test_vocabulary_ranks_by_count_then_token(spark, rows):
    vocab = V.build_vocabulary(rows, words(F.col("text"), WORDS)).orderBy("token_id").collect()
    assert [(r.token, r.cnt) for r in vocab] == [("b", 3), ("a", 2), ("c", 1), ("d", 1)]
    frequent = V.token_counts(rows, words(F.col("text"), WORDS), 2).collect()
    assert {(r.token, r.cnt) for r in frequent} == {("b", 3), ("a", 2)}


def test_overlap_and_ratio(spark, vocab):
    target = spark.createDataFrame([("c", 0), ("x", 1), ("a", 2), ("A", 3)], "token string, token_id int")
    got = {(r.tgt_id, r.src_id) for r in V.vocabulary_overlap(target, vocab).collect()}
    assert got == {(0, 2), (2, 1)}
    assert tuple(V.overlap_ratio(target, vocab).first()) == (2, 4, 50.0)
    assert V.overlap_ratio(target.where("false"), vocab).first().percent is None


def test_extend_skips_known_and_repeated(spark, vocab):
    new = spark.createDataFrame([("z", 0), ("a", 1), ("y", 2), ("z", 3)], "token string, ord int")
    added = V.extend_vocabulary(vocab, new, "ord").where("added").orderBy("token_id").collect()
    assert [(r.token, r.token_id) for r in added] == [("z", 3), ("y", 4)]


def test_vocabulary_schema_is_checked(spark, vocab):
    assert V.check_vocabulary(vocab).columns == ["token", "token_id"]
    with pytest.raises(ValueError, match="token_id"):
        V.check_vocabulary(vocab.drop("token_id"))
    assert V.vocabulary_size(vocab).first()[0] == 3


def test_decode_falls_back_to_the_id(spark, vocab):
    df = spark.createDataFrame([(0, [2, 44, 0])], "row_idx bigint, input_ids array<int>")
    assert K.decode(df, vocab).first().decoded == "c 44 b"


def test_lines_limit_before_filter(spark):
    df = spark.createDataFrame(
        [(0, [1]), (1, [2] * 20), (2, [3] * 20)], "split_idx bigint, input_ids array<int>"
    )
    got = X.token_lines(df, 15, 2).collect()
    assert [r.split_idx for r in got] == [1]
    assert got[0].line == " ".join(["2"] * 20)
    assert X.token_lines(df).count() == 2


def test_line_round_trip(spark):
    df = spark.createDataFrame([([1, 22, 3],), ([],)], "ids array<int>")
    back = df.select(line_to_ids(ids_to_line(F.col("ids"))).alias("b")).collect()
    assert [r.b for r in back] == [[1, 22, 3], []]


def test_pairing(spark):
    a = spark.createDataFrame([(n, [n] * n) for n in range(6)], "split_idx bigint, input_ids array<int>")
    b = spark.createDataFrame([(n, [n] * (6 - n)) for n in range(6)], "split_idx bigint, input_ids array<int>")
    assert {r.sample_id for r in X.paired_rows(a, b, 2, 100).collect()} == {2, 3, 4}
    assert {r.sample_id for r in X.paired_rows(a, b, 2, 3).collect()} == {2}
    with pytest.raises(ValueError, match="cannot pair"):
        X.paired_rows(a, b.where("split_idx > 0"))


def test_split_names():
    assert X.split_name("valid") == "validation"
    assert X.split_name("train") == "train"
    with pytest.raises(ValueError):
        X.split_name("dev")


def test_large_lookup_sends_rows_once(spark):
    words = [f"w{n}" for n in range(400)]
    df = spark.createDataFrame([(n, " ".join(words[n : n + 50])) for n in range(300)], "row_idx long, text string")
    vocab = spark.createDataFrame([(w, n) for n, w in enumerate(words)], "token string, token_id int")
    found = lookup_values(df, F.split("text", " "), vocab, "ids", limit_bytes=0, drop=("text",), bucket_items=1000)
    rows = found.orderBy("row_idx").collect()
    assert [r.ids for r in rows] == [list(range(n, min(n + 50, 400))) for n in range(300)]
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # The second use of the rows reads the shuffle of the first.
    assert "ReusedExchange" in plan


def test_common_keys_are_bounded(spark, monkeypatch):
    vocab = spark.createDataFrame([(f"w{n}", n) for n in range(40)], "token string, token_id int")
    assert sorted(r._value for r in lookup.common_keys(vocab).collect()) == list(range(10))
    monkeypatch.setattr(lookup, "COMMON_KEYS", 4)
    assert sorted(r._value for r in lookup.common_keys(vocab).collect()) == [0, 1, 2, 3]
    by_key = vocab.select("token_id", "token")
    assert sorted(r._key for r in lookup.common_keys(by_key).collect()) == [0, 1, 2, 3]
    shared = spark.range(40).select("id", F.lit(0).alias("v"))
    assert lookup.common_keys(shared) is None
    assert lookup.common_keys(vocab.select("token", F.col("token").alias("t"))) is None


def test_library_gets_texts_in_bounded_parts(spark):
    def load():
        def encode(texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= K.ENCODED_CHARS
            return [[len(t)] for t in texts]

        return encode

    df = spark.range(40).select("id", F.repeat(F.lit("x"), F.lit(20_000)).alias("text")).coalesce(1)
    assert {r.ids[0] for r in df.select(K.library_tokeniser(load)("text").alias("ids")).collect()} == {20_000}
    assert [len(p) for p in K._parts(["aaa", "b", "cc", "ddddd"], 4)] == [2, 1, 1]


def test_items_are_not_computed_to_size_buckets(spark):
    from vocabbridge.operators import lookup

    df = spark.createDataFrame([(n, "a b " * n) for n in range(50)], "row_idx int, text string")
    failing = df.withColumn("_items", F.when(F.raise_error(F.lit("computed")).isNull(), F.split("text", " ")))
    assert lookup._item_count(df, failing) == -(-sum(4 * n + 24 for n in range(50)) // lookup.ITEM_BYTES)
    nested = df.select("row_idx", F.struct("text").alias("of"))
    assert lookup._item_count(nested, df.withColumn("_items", F.split("text", " "))) == sum(2 * n + 1 for n in range(50))


def test_many_branches_are_halved():
    import re

    from vocabbridge.functions.text import cut_pattern

    tokens = [a + b + c for a in "abcdefgh-]^\\é" for b in "xyz&[" for c in ("", "q", "r-", "r]", "s")]
    pattern = cut_pattern(tokens)
    text = " ".join(tokens) + "axr-axraqb^xr]]xs" + "zz"
    by_length = re.compile("|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True)))
    assert re.findall(pattern, text) == by_length.findall(text)
    # No node tries more than a few branches in turn.
    assert max(part.count("|") for part in re.findall(r"\(\?:[^()]*\)", pattern)) < 4 and "(?=[" in pattern


def test_stored_tables_are_packed_well(spark):
    from vocabbridge.plans import stages

    prepared = stages.prepare(spark.createDataFrame([(n, f"some words {n} " * 9) for n in range(40)], "doc_id long, text string"))
    for table in (prepared, stages.tokenise_source(prepared).rows):
        assert table.inputFiles() and all(".zstd." in name for name in table.inputFiles())
