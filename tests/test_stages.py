"""Whole stages on generated text: two spellings of one corpus must align to each other."""

import numpy as np
from pyspark.sql import functions as F

from vocabbridge.catalog import common, journey
from vocabbridge.operators import align, evaluate
from vocabbridge.plans import stages


def corpus(spark, n=400, seed=4):
    """Each text walks through a chain of words, so neighbours are informative."""
    rng = np.random.default_rng(seed)
    rows = []
    for doc in range(n):
        at, words = int(rng.integers(24)), []
        for _ in range(30):
            words.append(f"w{at:02d}")
            at = int((at + rng.choice([1, 1, 1, 2, 5])) % 24)
        rows.append((doc, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_renamed_copy_aligns_to_itself(spark, few_partitions):
    prepared = stages.prepare(corpus(spark))
    source = stages.tokenise_source(prepared)
    renamed = prepared.withColumn("text", F.translate("text", "w0123456789", "vabcdefghij"))
    target = stages.tokenise_source(renamed)
    assert target.vocab.count() == source.vocab.count() == 24
    truth = source.vocab.select(
        F.translate("token", "w0123456789", "vabcdefghij").alias("token"), F.col("token_id").alias("src_id")
    ).join(target.vocab.select("token", F.col("token_id").alias("tgt_id")), "token")
    gold = truth.where(F.col("tgt_id") < 12).select("tgt_id", "src_id")
    options = {"window": 4, "min_count": 1, "dims": 12, "passes": 40, "rate": 0.2, "schedule": "batch"}
    alignment = stages.align_vocabularies(
        gold,
        stages.fit_vectors(target, seed=1, **options),
        stages.fit_vectors(source, seed=2, **options),
        24, 24, pivots=12, metric="cosine",
    )
    right = alignment.join(truth.withColumnRenamed("src_id", "true_id"), "tgt_id").where("src_id = true_id")
    assert right.count() == 24
    scored = stages.score(stages.evaluation_pairs(source, target), alignment).first()
    assert scored.mean_bleu == 1.0 and scored.n_unmapped == 0


def test_blocks_and_overlap_score(spark):
    prepared = stages.prepare(corpus(spark, 60))
    side = stages.tokenise_target(prepared)
    blocks = stages.training_blocks(side, 64)
    assert blocks.where("split = 'train'").where(F.size("input_ids") != 64).count() == 0
    total = side.rows.where("split = 'train'").agg(F.sum(F.size("input_ids"))).first()[0]
    assert blocks.where("split = 'train'").count() == total // 64
    source = stages.tokenise_source(prepared)
    pairs = stages.evaluation_pairs(source, side)
    score = stages.score(pairs, stages.overlap_alignment(source, side)).first()
    assert score.mean_bleu == 1.0
    assert evaluate.unmapped_ids(pairs, stages.overlap_alignment(source, side)).count() == 0


def test_given_validation_is_its_own_split(spark):
    train = corpus(spark, 30)
    held_out = corpus(spark, 4, seed=9).unionByName(spark.createDataFrame([(9, "too short")], "doc_id bigint, text string"))
    rows = stages.prepare(train, validation=held_out).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(34))
    assert [(r.split, r.split_idx) for r in rows] == [("validation", n) for n in range(4)] + [("train", n) for n in range(30)]
    assert rows[0].text == held_out.where("doc_id = 0").first().text


def test_token_budget_ends_with_its_batch(spark):
    rows = stages.prepare(corpus(spark, 30), token_budget=200, batch_rows=4)
    assert rows.count() == 8 and rows.where("split = 'validation'").count() == 0


def test_extended_vocabulary_in_a_stage(spark):
    prepared = stages.prepare(corpus(spark, 20))
    added = spark.createDataFrame([("01 w", 0), ("w0", 1)], "token string, ord int")
    plain = stages.tokenise_with(prepared, r"\S+")
    side = stages.tokenise_with(prepared, r"\S+", added=added)
    assert side.vocab.count() == plain.vocab.count() + 2
    ids = {r.token: r.token_id for r in side.vocab.collect()}
    text = prepared.where("row_idx = 0").first().text
    got = side.rows.where("row_idx = 0").first().input_ids
    # Each begin "w0" is cut out first, so no "01 w" is left to be found.
    assert "01 w" in text and got.count(ids["01 w"]) == 0
    assert got.count(ids["w0"]) == sum(w.startswith("w0") for w in text.split()) > 0


def test_tokens_seen_five_times_get_a_vector(spark, few_partitions, tmp_path):
    words = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
    texts = [" ".join(words[(n * k) % 12] for k in range(14)) + (" zeta.7 end" if n % 4 == 0 else "") for n in range(1, 41)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    rows = journey.fitted_alignment(spark, str(tmp_path)).collect()
    vocab = {r.token: r for r in common.target(spark, str(tmp_path)).vocab.collect()}
    assert vocab["zeta"].cnt == 10
    origin = {r.tgt_id: r.origin for r in rows}
    assert len(origin) == len(rows) == len(vocab)
    assert origin[vocab["zeta"].token_id] == "vector" and origin[vocab["two"].token_id] == "gold"
    assert (journey.WINDOW, journey.MIN_COUNT, journey.PASSES) == (15, 5, 15)


def test_nearest_is_asked_only_where_no_gold_pair_wins(spark, monkeypatch):
    vectors = spark.createDataFrame([(str(n), n, [1.0, float(n)]) for n in range(4)], "token string, ord bigint, vector array<double>")
    gold = spark.createDataFrame([(0, 3), (1, None), (2, 1), (2, None)], "tgt_id int, src_id int")
    asked, nearest = [], align.nearest
    monkeypatch.setattr(align, "nearest", lambda t, s, **o: (asked.extend(r.id for r in t.collect()), nearest(t, s, **o))[1])
    got = stages.align_vocabularies(gold, vectors, vectors, 5, 4, relative=False).collect()
    assert sorted(asked) == [1, 2, 3]
    rows = sorted((r.tgt_id, r.src_id, r.origin) for r in got)
    assert rows[:5] == [(0, 3, "gold"), (1, 1, "vector"), (2, 1, "gold"), (2, 2, "vector"), (3, 3, "vector")]
    assert len(rows) == 6 and rows[5][2] == "random"
    every = gold.where("src_id IS NOT NULL").unionAll(spark.createDataFrame([(1, 0), (3, 0)], gold.schema))
    assert {r.origin for r in stages.align_vocabularies(every, vectors, vectors, 4, 4, relative=False).collect()} == {"gold"}
