"""Spelling variants of words, found through pivotal grams.

Words that differ by one inserted, deleted or replaced code point are near.  The bigrams
of a word are ordered by how rare they are in all words.  Its gram prefix is its three
rarest places, with all places as rare as the third; of these, dynamic programming picks
two disjoint ones of least total frequency, the pivots.  One edit cannot touch both, and
of two near words the one whose prefix ends first has its intact pivots in the prefix of
the other.  So the pivots are indexed and asked for at the other words' prefix grams.

A bigram alone is a weak key, and position limits sharpen it: where the edit is in
relation to the two pivots says which letters cannot have changed.  After the second
pivot: the word through it.  Before the first: the word from it on.  Between them: the
begin through the first and the end from the second.  On a pivot: the words are equal
once a code point at that pivot is taken away from the longer, or from both.  These four
pieces are the keys of the index; no near pair is lost.  What shares a key is verified by
edit distance inside the join, so only near pairs leave it.

Nulls and edges: a null text has no words.  A null ``doc_id`` counts as the empty string
in the hash that chooses deletions.  A word without near words has a null form, itself
as root and ``n_near`` 0.  Repeated rows count once per row.  An empty table gives no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabbridge.llm.dedup import normalised
from vocabbridge.storage import stored

# One run in this many (by hash) loses a code point.
DELETE_EVERY = 31
MIN_LENGTH = 7
MIN_COUNT = 2
# A form is this many times as frequent as its variant.
RATIO = 10
# Grams of a prefix: 2 letters * 1 edit + 1, so that two of them are disjoint.
PREFIX = 3
# Words whose keys are made at a time.
ROWS = 2000
LETTERS = "A-Za-zÀ-ÿ"


def found_words(docs: DataFrame, doc_id: str, text: str, min_length: int) -> DataFrame:
    """``word``: one row per run of letters, after the hashed deletions."""
    low = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("__id"), normalised(F.col(text)).alias("__text"))
    # A shorter run cannot give a word, and greedy matches of this length are whole runs.
    runs = F.regexp_extract_all("__text", F.lit(f"([{LETTERS}]{{{min_length},}})"), F.lit(1))
    each = low.select("__id", F.explode(runs).alias("__run"))
    hashed = each.select("__run", F.crc32(F.concat("__id", F.lit(":"), "__run").cast("binary")).alias("__h"))
    place = (F.col("__h") % F.length("__run")).cast("int")
    cut = F.concat(F.substring("__run", F.lit(1), place), F.substring("__run", place + 2, F.length("__run")))
    word = F.when(F.col("__h") % DELETE_EVERY == 0, cut).otherwise(F.col("__run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= min_length)


def word_counts(docs: DataFrame, doc_id: str, text: str, min_length: int, min_count: int) -> DataFrame:
    """``word, n`` of the words that occur at least ``min_count`` times."""
    counted = found_words(docs, doc_id, text, min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, str]]:
    """How rare each bigram is: (places in all words, gram).

    The letters are 26 and 64 more, so there are at most 8,100 bigrams to collect.
    """
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(places, lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    rows = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    return {row.gram: (row.n, row.gram) for row in rows}


def gram_prefix(word: str, ranks: dict[str, tuple[int, str]]) -> list[int]:
    """The places of the ``PREFIX`` rarest bigrams, and of all as rare as the last of them."""
    order = [ranks[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(order)[PREFIX - 1]
    return [i for i, rank in enumerate(order) if rank <= last]


def pivots(word: str, places: list[int], ranks: dict[str, tuple[int, str]]) -> tuple[int, int]:
    """The two disjoint places of least total frequency, by dynamic programming.

    ``best`` is the cheapest place that ends before the current one begins; each place
    is tried as the second of the pair.
    """
    costs = [ranks[word[i : i + 2]][0] for i in places]
    chosen, total, best, free = (places[0], places[-1]), None, None, 0
    for at, cost in zip(places, costs, strict=True):
        while places[free] <= at - 2:
            if best is None or costs[free] < best[0]:
                best = (costs[free], places[free])
            free += 1
        if best is not None and (total is None or best[0] + cost < total):
            chosen, total = (best[1], at), best[0] + cost
    return chosen


def without(word: str, at: int) -> str:
    """What is left of the word when the code point at ``at`` is taken away."""
    return "=" + word[:at] + word[at + 1 :]


def index_pieces(word: str, first: int, second: int) -> set[str]:
    """What an edit after, before, between or on the two pivots leaves of the word."""
    touched = (first, first + 1, second, second + 1)
    sides = {"<" + word[: second + 2], ">" + word[first:], f"|{word[: first + 2]}|{word[second:]}"}
    return sides | {"=" + word} | {without(word, at) for at in touched}


def asked_pieces(word: str, places: list[int]) -> set[str]:
    """The same pieces, were the pivots any of the word's prefix grams."""
    sides = {"<" + word[: i + 2] for i in places} | {">" + word[i:] for i in places}
    both = {f"|{word[: i + 2]}|{word[j:]}" for i in places for j in places if j >= i + 2}
    return sides | both | {"=" + word} | {without(word, at) for at in range(len(word))}


def index_keys(words: DataFrame, ranks: dict[str, tuple[int, str]]) -> DataFrame:
    """``word, n, key, pivot``: the hashed pieces of each word; ``pivot`` marks those in the index."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def keys(batches):
        ranks = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                row, key, pivot = [], [], []
                for number, word in enumerate(part.column(0).to_pylist()):
                    places = gram_prefix(word, ranks)
                    own = index_pieces(word, *pivots(word, places, ranks))
                    asked = asked_pieces(word, places)
                    row += [number] * len(asked)
                    key += asked
                    pivot += [piece in own for piece in asked]
                kept = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(key, pa.string()), pa.array(pivot, pa.bool_())],
                    names=["word", "n", "piece", "pivot"],
                )

    rows = words.select("word", "n").mapInArrow(keys, "word string, n long, piece string, pivot boolean")
    return rows.select("word", "n", F.xxhash64("piece").alias("key"), "pivot")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n`` with a < b: every pair of near words once.

    ``words`` holds ``word, n``, words distinct and of ``MIN_LENGTH`` code points at least
    (four would do for two disjoint bigrams in a prefix).
    """
    keys = stored(index_keys(words, gram_ranks(words)), "grams")
    index = keys.where("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    asked = keys.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    # Bytes differ by two at most where one code point below U+0800 does.
    alike = (F.abs(F.octet_length("a") - F.octet_length("b")) <= 2) & (F.levenshtein("a", "b", 1) == 1)
    joined = index.join(asked, "key").where(alike)
    swap = F.col("a") > F.col("b")

    def side(low: str, high: str) -> Column:
        return F.when(swap, F.col(high)).otherwise(F.col(low))

    return joined.select(
        side("a", "b").alias("a"), side("a_n", "b_n").alias("a_n"), side("b", "a").alias("b"), side("b_n", "a_n").alias("b_n")
    ).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: the end of each word's chain of forms.

    Pointers are doubled and written each round.  A form is ``RATIO`` times as frequent as
    its variant, so a chain over 64-bit counts has fewer than 20 links and ends in
    5 rounds; no word is the form of more words than one edit reaches.
    """
    links = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(
            links.join(onward, "root", "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
            ),
            "roots",
        )
        links = moved.select("word", "root")
        if not moved.where("_moved").limit(1).count():
            return links


def spelling_variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT, ratio: int = RATIO,
) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    The form is the most frequent near word (ties: the first in code-point order) if it
    is ``ratio`` times as frequent, the root the last of the chain of forms.
    """
    words = stored(word_counts(docs, doc_id, text, min_length, min_count), "words")
    pairs = near_pairs(words)
    ends = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")),
    )
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = pairs.select(F.inline(ends)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    frequent = -F.col("best.less") >= F.col("n") * ratio
    formed = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(frequent, F.col("best.other")).alias("form"),
            F.when(frequent, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    ended = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ended, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
