import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vocabbridge.functions.text import strip, text_to_json
from vocabbridge.operators import corpus as C
from vocabbridge.operators import rowindex as R

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def texts(spark, *values):
    return spark.createDataFrame([(n, v) for n, v in enumerate(values)], "row_idx bigint, text string")


def test_strip_removes_what_python_strips(spark):
    white = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    values = [f"{w}a{w}b{w}" for w in white] + ["​a​", "a", ""]
    got = texts(spark, *values).orderBy("row_idx").select(strip(F.col("text")).alias("t")).collect()
    assert [r.t for r in got] == [v.strip() for v in values]


def test_length_counts_code_points_and_fifty_is_kept(spark):
    rows = texts(spark, "x" * 49, "x" * 50, "\U0001f600" * 50, "\U0001f600" * 49)
    assert [r.row_idx for r in C.keep_rows(rows).orderBy("row_idx").collect()] == [1, 2]


def test_blank_and_missing_texts_count_as_empty(spark):
    rows = C.mark_rows(texts(spark, "", "  \t", " ", None, "short", "y" * 60))
    fates = {r.fate: r["count"] for r in rows.groupBy("fate").count().collect()}
    assert fates == {"empty": 4, "short": 1, "kept": 1}


@pytest.mark.parametrize(("target", "batches"), [(5, 2), (4, 1), (0, 1), (12, 3), (100, 3)])
def test_budget_takes_whole_batches(spark, target, batches):
    marked = spark.range(6).select(
        F.col("id").alias("row_idx"), F.lit("kept").alias("fate"), F.lit(2).alias("n_tokens")
    )
    got = C.within_budget(marked, target, batch_rows=2)
    assert got.select("batch").distinct().count() == batches
    assert got.count() == 2 * batches


def test_statistics_of_nothing(spark):
    marked = spark.createDataFrame([(0, "empty", None)], "row_idx bigint, fate string, n_tokens int")
    assert tuple(C.corpus_statistics(marked).first()) == (0, 0, 1, 0)


@pytest.mark.parametrize(("n", "held_out"), [(10, 0), (30, 2), (50, 2), (70, 4), (0, 0)])
def test_head_split_rounds_half_to_even(spark, n, held_out):
    split = C.head_split(spark.range(n).withColumnRenamed("id", "row_idx"))
    got = {r.split: r.n_rows for r in C.split_sizes(split).collect()}
    assert got.get("validation", 0) == held_out
    assert got.get("train", 0) == n - held_out
    places = [r.split_idx for r in split.where("split = 'train'").orderBy("row_idx").collect()]
    assert places == list(range(n - held_out))


def test_evaluation_split_prefers_test():
    assert C.evaluation_split(["test", "train", "validation"]) == "test"
    assert C.evaluation_split(["train", "validation"]) == "validation"


def test_characters_per_token(spark):
    rows = spark.createDataFrame([(0, "abcd", 2), (1, "ab", 1), (2, "zzzzzzzz", 1)], "row_idx bigint, text string, n_tokens int")
    assert C.chars_per_token(rows, 2).first()[0] == pytest.approx(2.0)
    assert C.chars_per_token(rows.drop("text"), 2).first()[0] == 1.0
    assert C.chars_per_token(rows.where("false"), 2).first()[0] is None


def test_json_keeps_characters(spark):
    row = texts(spark, 'añ"😀').select(text_to_json(F.col("text")).alias("j")).first()
    assert row.j == '{"text":"añ\\"😀"}'


@FEW
@given(keys=st.lists(st.tuples(st.integers(-50, 50), st.text(max_size=4)), unique=True, min_size=1, max_size=60))
def test_row_index_follows_the_order(spark, keys):
    df = spark.createDataFrame(keys, "a int, b string").repartition(5)
    got = R.with_row_index(df, F.desc("a"), F.asc("b")).orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(len(keys)))
    assert [(r.a, r.b) for r in got] == sorted(keys, key=lambda k: (-k[0], k[1].encode()))


def test_row_index_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for parts in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(tuple(r) for r in R.with_row_index(df.repartition(7), "k").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2] == [(n, n) for n in range(1000)]


@FEW
@given(values=st.lists(st.integers(0, 9), min_size=1, max_size=40), span=st.integers(1, 9))
def test_running_before_for_any_span(spark, values, span):
    df = spark.createDataFrame(list(enumerate(values)), "i bigint, v bigint")
    got = R.R.running_before(df, "i", "v", "before", span=span).orderBy("i").collect()
    assert [r.before for r in got] == [sum(values[:n]) for n in range(len(values))]


@FEW
@given(n=st.integers(1, 40), parts=st.integers(1, 9))
def test_contiguous_parts(spark, n, parts):
    part, place = R.contiguous_part(F.col("id"), F.lit(n), parts)
    rows = spark.range(n).select("id", part.alias("part"), place.alias("place")).orderBy("id").collect()
    sizes = [n // parts + (p < n % parts) for p in range(parts)]
    assert [(r.part, r.place) for r in rows] == [(p, k) for p in range(parts) for k in range(sizes[p])]


def test_rotation_shards_and_repeats(spark):
    rows = spark.range(5).withColumnRenamed("id", "row_idx")
    turned = R.rotate(rows, 2).orderBy("feed_idx").collect()
    assert [r.row_idx for r in turned] == [2, 3, 4, 0, 1]
    assert [r.row_idx for r in R.rotate(rows, 12).orderBy("feed_idx").collect()] == [2, 3, 4, 0, 1]
    shards = [{r.row_idx for r in R.strided_shard(rows, w, 2).collect()} for w in (0, 1)]
    assert shards == [{0, 2, 4}, {1, 3}]
    assert R.repeat(rows, 3).orderBy("epoch", "row_idx").count() == 15


def test_running_totals_over_many_levels(spark, few_partitions):
    values = [(n, n * 37 % 11, "ab"[n % 2]) for n in range(150)]
    df = spark.createDataFrame(values, "row_idx bigint, v bigint, k string")
    total = R.running_before(df, "row_idx", "v", "before", span=4)
    expected = [sum(v for _, v, _ in values[:n]) for n in range(150)]
    assert [r.before for r in total.orderBy("row_idx").collect()] == expected
    plan = total._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "SinglePartition" not in plan
    keyed = R.running_before(df, "row_idx", "v", "before", ("k",), span=4).orderBy("row_idx").collect()
    assert [r.before for r in keyed] == [sum(v for _, v, k in values[:n] if k == "ab"[n % 2]) for n in range(150)]
    assert R.running_before(df.where("v < 0"), "row_idx", "v", "before", span=4).count() == 0
