"""The stages of a vocabulary change, corpus to rearranged embeddings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabbridge.functions.text import WORDS, WORDS_AND_MARKS, words
from vocabbridge.operators import align, cooccur, corpus, evaluate, export, glove, packing
from vocabbridge.operators.rowindex import with_row_index
from vocabbridge.operators.tokenise import tokenise
from vocabbridge.operators.vocabulary import (
    MIN_COUNT, added_tokens, build_vocabulary, extend_vocabulary, vocabulary_overlap,
)
from vocabbridge.storage import SMALL, stored


@dataclass
class Tokenised:
    """A corpus in one vocabulary: ``vocab`` and ``rows`` (with ``split, split_idx, input_ids``)."""

    vocab: DataFrame
    rows: DataFrame


def prepare(
    documents: DataFrame,
    key: str = "doc_id",
    percent: int = corpus.VALIDATION_PERCENT,
    validation: DataFrame | None = None,
    token_budget: int | None = None,
    pattern: str = WORDS,
    batch_rows: int = corpus.BATCH_ROWS,
) -> DataFrame:
    """Cleaned rows with ``row_idx``, ``split`` and ``split_idx``.

    A given ``validation`` table is the validation split; without one the head of the
    documents is.  With a ``token_budget`` the documents end with the batch of raw rows
    that reaches so many words of ``pattern``.
    """
    kept = _kept(documents, key, token_budget, pattern, batch_rows)
    if validation is None:
        return corpus.head_split(kept, percent)
    return corpus.given_split(kept, _kept(validation, key, None, pattern, batch_rows))


def _kept(documents: DataFrame, key: str, token_budget: int | None, pattern: str, batch_rows: int) -> DataFrame:
    """The rows that are long enough, numbered; whole batches up to the budget if there is one."""
    rows = documents.select(key, "text")
    if token_budget is None:
        return with_row_index(corpus.keep_rows(rows), key)
    marked = corpus.mark_rows(rows)
    n_tokens = F.when(F.col("fate") == "kept", F.size(words(F.col("text"), pattern)))
    numbered = with_row_index(marked.withColumn("n_tokens", n_tokens), key)
    taken = corpus.within_budget(numbered, token_budget, batch_rows)
    return with_row_index(taken.where("fate = 'kept'").select(key, "text"), key)


def tokenise_with(
    prepared: DataFrame, pattern: str, label: str = "tokens", added: DataFrame | None = None, order: tuple[str, ...] = ("ord",)
) -> Tokenised:
    """Vocabulary of all words of the corpus, and the corpus written as its ids.

    ``added`` lists further tokens (``token`` and the ``order`` columns).  Those that the
    vocabulary lacks extend it, and are cut out of the texts before these are split into
    words.
    """
    vocab = build_vocabulary(prepared, words(F.col("text"), pattern))
    columns, cut = ["row_idx", "split", "split_idx", "text"], []
    if added is not None:
        extended = stored(extend_vocabulary(vocab, added, *order), "extended")
        cut = added_tokens(extended)
        vocab = extended.join(vocab.select("token_id", "cnt"), "token_id", "left").select("token_id", "token", "cnt")
    rows = tokenise(prepared.select(*columns), vocab, pattern, added=cut)
    return Tokenised(vocab, stored(rows, label, compression=SMALL))


def tokenise_source(prepared: DataFrame) -> Tokenised:
    """The old vocabulary's stand-in: white-space words."""
    return tokenise_with(prepared, WORDS, "source")


def tokenise_target(prepared: DataFrame) -> Tokenised:
    """The new vocabulary's stand-in: runs of letters and digits, and single marks."""
    return tokenise_with(prepared, WORDS_AND_MARKS, "target")


def evaluation_pairs(source: Tokenised, target: Tokenised) -> DataFrame:
    """Paired rows of the held-out split."""
    held_out = F.col("split") == export.split_name("validation")
    return export.paired_rows(
        source.rows.where(held_out),
        target.rows.where(held_out),
        export.MIN_TOKENS_EVAL,
    )


def vector_vocabulary(vocab: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Tokens that get a vector.  Token ids are ranks by count, so they serve as vector ids."""
    frequent = vocab.where(F.col("cnt") >= min_count)
    return frequent.select("token_id", F.col("token_id").alias("vec_id"))


def count_pairs(tokenised: Tokenised, window: int = cooccur.WINDOW, min_count: int = MIN_COUNT) -> DataFrame:
    """Co-occurrences of the training split."""
    return cooccur.unpacked_counts(count_packed(tokenised, window, min_count))


def count_packed(tokenised: Tokenised, window: int = cooccur.WINDOW, min_count: int = MIN_COUNT) -> DataFrame:
    """Co-occurrences of the training split as packed bytes, the form a fit reads."""
    train = tokenised.rows.where(F.col("split") == "train").select("row_idx", "input_ids")
    ids = vector_vocabulary(tokenised.vocab, min_count)
    return cooccur.packed_counts(cooccur.in_vocabulary(train, ids), window)


def fit_vectors(tokenised: Tokenised, window: int = cooccur.WINDOW, min_count: int = MIN_COUNT, **options) -> DataFrame:
    """``token, ord, vector`` for the frequent tokens of a corpus."""
    ids = vector_vocabulary(tokenised.vocab, min_count)
    pairs = stored(count_packed(tokenised, window, min_count), "pairs")
    params = glove.fit(pairs, ids, **options)
    return glove.token_vectors(params, ids)


def align_vocabularies(
    gold: DataFrame,
    target_vectors: DataFrame,
    source_vectors: DataFrame,
    target_size: int,
    source_size: int,
    pivots: int = align.PIVOTS,
    relative: bool = True,
    metric: str = "dot",
    seed: int | str = 0,
) -> DataFrame:
    """A source id for every target id.  Nearest vectors are searched for the ids without a gold pair.

    Relative vectors are compared by inner product, as the workload does; ``cosine``
    keeps long vectors from winning everywhere.
    """
    target = align.usable_vectors(target_vectors)
    source = align.usable_vectors(source_vectors)
    if relative:
        chosen = stored(align.choose_pivots(gold, target, source, pivots, seed), "pivots")
        target = stored(align.relative_vectors(target, chosen, "tgt_id"), "relative")
        source = stored(align.relative_vectors(source, chosen, "src_id"), "relative")
    best = align.nearest(align.without_gold(target, gold), source, metric=metric)
    return align.resolve(target_size, source_size, gold, best, gold.sparkSession, seed)


def overlap_alignment(source: Tokenised, target: Tokenised) -> DataFrame:
    """The alignment that exact spelling alone gives."""
    return vocabulary_overlap(target.vocab, source.vocab)


def score(pairs: DataFrame, alignment: DataFrame, weights=evaluate.BLEU_WEIGHTS) -> DataFrame:
    """Mean BLEU and unmapped rate of an alignment in one row."""
    mapped = stored(evaluate.map_targets(pairs, alignment), "mapped")
    bleu = evaluate.mean_bleu(evaluate.sentence_bleu(mapped, weights))
    rate = evaluate.unmapped_rate(evaluate.occurrences(mapped))
    return bleu.withColumns(
        {
            "n_tokens": rate.select("n_tokens").scalar(),
            "n_unmapped": rate.select("n_unmapped").scalar(),
            "percent_unmapped": rate.select("percent").scalar(),
        }
    )


def training_blocks(target: Tokenised, block: int, shards: int = 1) -> DataFrame:
    """Fixed-length blocks of both splits."""
    return packing.pack(target.rows.select("split", "split_idx", "input_ids"), block, shards=shards)
