"""Tokeniser, vocabulary and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocabbridge.catalog.common import (
    BOTH, CORPUS, OVERLAP, PAIRS, SRC, TGT, overlap, pairs, plain, prepared, source, target, table,
)
from vocabbridge.functions.sequences import ids_to_line, line_to_ids
from vocabbridge.functions.text import WORDS, WORDS_AND_MARKS, words
from vocabbridge.operators import export as X
from vocabbridge.operators import tokenise as K
from vocabbridge.operators import vocabulary as V
from vocabbridge.plans import stages

# Pairs of the held-out rows that a limited export takes: fewer than there are.
LIMIT = 20


def _rows(prepared_rows):
    return prepared_rows.select("row_idx", "text")


def _lines(tokens):
    return plain(
        tokens.select(
            "row_idx",
            F.size("input_ids").alias("n_tokens"),
            F.md5(ids_to_line(F.col("input_ids"))).alias("line_md5"),
        )
    )


def tokenise_words(spark, folder):
    return _lines(K.tokenise(_rows(prepared(spark, folder)), source(spark, folder).vocab, WORDS))


def tokenise_words_and_marks(spark, folder):
    vocab = target(spark, folder).vocab
    return _lines(K.tokenise(_rows(prepared(spark, folder)), vocab, WORDS_AND_MARKS))


def tokenise_special_tokens(spark, folder):
    rows, vocab = _rows(prepared(spark, folder)), source(spark, folder).vocab
    return _lines(K.tokenise(rows, vocab, WORDS, bos=1_000_001, eos=1_000_002))


def tokenise_frequent_only(spark, folder):
    vocab = source(spark, folder).vocab.where(F.col("cnt") >= V.MIN_COUNT)
    return _lines(K.tokenise(_rows(prepared(spark, folder)), vocab, WORDS, unknown=1_000_000))


def tokenise_joined(spark, folder):
    """The path for vocabularies too large to broadcast."""
    rows, vocab = _rows(prepared(spark, folder)), target(spark, folder).vocab
    return _lines(K.tokenise(rows, vocab, WORDS_AND_MARKS, limit_bytes=0))


def byte_encoder():
    """Byte-level encoder of the ``tokenizers`` library: one id per UTF-8 byte."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
    tokenizer = Tokenizer(models.BPE({c: n for n, c in enumerate(alphabet)}, []))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def tokenise_library(spark, folder):
    encode = K.library_tokeniser(byte_encoder)
    rows = prepared(spark, folder).select("row_idx", encode("text").alias("input_ids"))
    return plain(rows.select("row_idx", K.token_count(F.col("input_ids")).alias("n_tokens")))


def tokenised_rows(spark, folder):
    """Saved rows: input columns gone, declared types kept."""
    rows = target(spark, folder).rows
    ids_type = rows.schema["input_ids"].dataType.simpleString()
    mask_type = rows.schema["attention_mask"].dataType.simpleString()
    return plain(
        rows.select(
            "row_idx",
            F.size("input_ids").alias("n_ids"),
            F.size(F.filter("attention_mask", lambda m: m)).alias("n_mask"),
            F.lit(ids_type).alias("ids_type"),
            F.lit(mask_type).alias("mask_type"),
            F.lit("text" in rows.columns).alias("has_text"),
        )
    )


def source_vocabulary(spark, folder):
    vocab = V.build_vocabulary(prepared(spark, folder), words(F.col("text"), WORDS))
    return plain(vocab.select("token_id", "token", "cnt"))


def target_vocabulary(spark, folder):
    vocab = V.build_vocabulary(prepared(spark, folder), words(F.col("text"), WORDS_AND_MARKS))
    return plain(vocab.select("token_id", "token", "cnt"))


def frequent_tokens(spark, folder):
    counts = V.token_counts(source(spark, folder).rows, F.col("input_ids"), V.MIN_COUNT)
    return plain(counts.select(F.col("token").alias("token_id"), "cnt"))


def vocabulary_sizes(spark, folder):
    src = V.vocabulary_size(source(spark, folder).vocab).withColumn("side", F.lit("source"))
    tgt = V.vocabulary_size(target(spark, folder).vocab).withColumn("side", F.lit("target"))
    return plain(src.unionByName(tgt))


def extended_vocabulary(spark, folder):
    items = table(spark, folder, "benchmark").select(
        "item_id", F.posexplode(words(F.col("text"), WORDS)).alias("pos", "token")
    )
    return plain(V.extend_vocabulary(source(spark, folder).vocab, items, "item_id", "pos"))


def decoded_rows(spark, folder):
    side = target(spark, folder)
    shown = K.decode(side.rows.select("row_idx", "input_ids"), side.vocab)
    return shown.select("row_idx", F.md5("decoded").alias("decoded_md5"))


def decoded_frequent(spark, folder):
    side = target(spark, folder)
    frequent = side.vocab.where(F.col("cnt") >= V.MIN_COUNT)
    shown = K.decode(side.rows.select("row_idx", "input_ids"), frequent)
    return shown.select("row_idx", F.md5("decoded").alias("decoded_md5"))


def decoded_joined(spark, folder):
    """The path for vocabularies too large to broadcast."""
    side = target(spark, folder)
    shown = K.decode(side.rows.select("row_idx", "input_ids"), side.vocab, limit_bytes=0)
    return shown.select("row_idx", F.md5("decoded").alias("decoded_md5"))


def token_lines(spark, folder):
    train = source(spark, folder).rows.where(F.col("split") == "train")
    lines = X.token_lines(train, min_tokens=20)
    return lines.select("split_idx", F.md5("line").alias("line_md5"))


def token_lines_head(spark, folder):
    """The head limit counts rows before the length filter."""
    train = source(spark, folder).rows.where(F.col("split") == "train")
    lines = X.token_lines(train, min_tokens=100, max_lines=150)
    return lines.select("split_idx", F.md5("line").alias("line_md5"))


def paired_rows(spark, folder):
    rows = pairs(spark, folder)
    return plain(
        rows.select(
            "sample_id",
            F.md5(ids_to_line(F.col("src_ids"))).alias("src_md5"),
            F.md5(ids_to_line(F.col("tgt_ids"))).alias("tgt_md5"),
        )
    )


def paired_rows_limited(spark, folder):
    """The head limit counts pairs before the length filter."""
    held_out = F.col("split") == "validation"
    rows = X.paired_rows(
        source(spark, folder).rows.where(held_out), target(spark, folder).rows.where(held_out), 10, max_lines=LIMIT
    )
    return plain(rows.select("sample_id", F.size("src_ids").alias("n_src"), F.size("tgt_ids").alias("n_tgt")))


def tokenise_extended(spark, folder):
    """A vocabulary extended by begins of benchmark words, which overlap each other."""
    word = F.col("word")
    items = table(spark, folder, "benchmark").select(
        "item_id", F.posexplode(words(F.col("text"), WORDS)).alias("pos", "word")
    )
    begins = items.where(F.length(word) >= 4).select(
        "item_id", "pos", F.explode(F.array(F.lit(2), F.lit(3))).alias("k"), "word"
    )
    added = begins.select("item_id", "pos", "k", F.substring(word, F.lit(1), F.col("k")).alias("token"))
    side = stages.tokenise_with(prepared(spark, folder), WORDS, "extended", added, ("item_id", "pos", "k"))
    return _lines(side.rows)


def paired_training_rows(spark, folder):
    """Pairing without a head limit, over the whole training split."""
    train = F.col("split") == "train"
    rows = X.paired_rows(
        source(spark, folder).rows.where(train), target(spark, folder).rows.where(train), 10, 1 << 60
    )
    return plain(
        rows.select(
            "sample_id", F.size("src_ids").alias("n_src"), F.size("tgt_ids").alias("n_tgt")
        )
    )


def line_round_trip(spark, folder):
    rows = target(spark, folder).rows
    back = line_to_ids(ids_to_line(F.col("input_ids")))
    total = F.aggregate(back, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return plain(rows.select("row_idx", F.size(back).alias("n"), total.alias("id_sum")))


def vocabulary_overlap(spark, folder):
    found = V.vocabulary_overlap(target(spark, folder).vocab, source(spark, folder).vocab)
    return plain(found)


def overlap_ratio(spark, folder):
    return plain(V.overlap_ratio(target(spark, folder).vocab, source(spark, folder).vocab))


QUERIES = {
    f.__name__: f
    for f in (
        tokenise_words, tokenise_words_and_marks, tokenise_special_tokens, tokenise_frequent_only,
        tokenise_joined, tokenise_library, tokenised_rows, source_vocabulary, target_vocabulary,
        frequent_tokens, vocabulary_sizes, extended_vocabulary, decoded_rows, decoded_frequent, decoded_joined,
        token_lines, token_lines_head, paired_rows, paired_rows_limited, tokenise_extended, paired_training_rows, line_round_trip,
        vocabulary_overlap, overlap_ratio,
    )
}


def _line_sql(tok: str, key: str = "row_idx", where: str = "true") -> str:
    return f"""SELECT {key}, count(*) AS n_tokens,
        md5(string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY pos)) AS line_md5
        FROM {tok} WHERE {where} GROUP BY {key}"""


_S = f"WITH {CORPUS},{SRC}"
_T = f"WITH {CORPUS},{TGT}"

SQL = {
    "tokenise_words": f"{_S} {_line_sql('src_tok')}",
    "tokenise_words_and_marks": f"{_T} {_line_sql('tgt_tok')}",
    "tokenise_joined": f"{_T} {_line_sql('tgt_tok')}",
    "tokenise_special_tokens": f"""{_S} SELECT row_idx, count(*) + 2 AS n_tokens,
        md5('1000001 ' || string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY pos) || ' 1000002') AS line_md5
        FROM src_tok GROUP BY row_idx""",
    "tokenise_frequent_only": f"""{_S}, known AS (SELECT row_idx, pos,
          CASE WHEN cnt >= 5 THEN token_id ELSE 1000000 END AS token_id
          FROM src_word JOIN src_vocab USING (token))
        {_line_sql('known')}""",
    "tokenise_library": f"WITH {CORPUS} SELECT row_idx, strlen(text) AS n_tokens FROM corpus",
    "tokenised_rows": f"""{_T} SELECT row_idx, count(*) AS n_ids, count(*) AS n_mask,
        'array<int>' AS ids_type, 'array<boolean>' AS mask_type, false AS has_text
        FROM tgt_tok GROUP BY row_idx""",
    "source_vocabulary": f"{_S} SELECT token_id, token, cnt FROM src_vocab",
    "target_vocabulary": f"{_T} SELECT token_id, token, cnt FROM tgt_vocab",
    "frequent_tokens": f"{_S} SELECT token_id, count(*) AS cnt FROM src_tok GROUP BY 1 HAVING count(*) >= 5",
    "vocabulary_sizes": f"""WITH {BOTH} SELECT 'source' AS side, max(token_id) + 1 AS vocab_size FROM src_vocab
        UNION ALL SELECT 'target', max(token_id) + 1 FROM tgt_vocab""",
    "extended_vocabulary": rf"""{_S},
        items AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos
          FROM (SELECT item_id, regexp_extract_all(text, '\S+') AS w FROM benchmark)),
        firsts AS (SELECT token, min((item_id, pos)) AS first_at FROM items
          WHERE token NOT IN (SELECT token FROM src_vocab) GROUP BY token)
        SELECT token, token_id, false AS added FROM src_vocab
        UNION ALL
        SELECT token, (SELECT max(token_id) FROM src_vocab) + row_number() OVER (ORDER BY first_at) AS token_id, true
        FROM firsts""",
    "decoded_rows": f"""{_T} SELECT row_idx, md5(string_agg(token, ' ' ORDER BY pos)) AS decoded_md5
        FROM tgt_word GROUP BY row_idx""",
    "decoded_joined": f"""{_T} SELECT row_idx, md5(string_agg(token, ' ' ORDER BY pos)) AS decoded_md5
        FROM tgt_word GROUP BY row_idx""",
    "decoded_frequent": f"""{_T} SELECT row_idx,
        md5(string_agg(CASE WHEN cnt >= 5 THEN token ELSE CAST(token_id AS VARCHAR) END, ' ' ORDER BY pos)) AS decoded_md5
        FROM tgt_word JOIN tgt_vocab USING (token) GROUP BY row_idx""",
    "token_lines": f"""{_S}, l AS ({_line_sql('src_tok', 'split_idx', "split = 'train'")})
        SELECT split_idx, line_md5 FROM l WHERE n_tokens >= 20""",
    "token_lines_head": f"""{_S}, l AS ({_line_sql('src_tok', 'split_idx', "split = 'train'")})
        SELECT split_idx, line_md5 FROM l WHERE split_idx < 150 AND n_tokens >= 100""",
    "paired_rows": f"""WITH {BOTH},{PAIRS},
        s AS ({_line_sql('src_tok')}), t AS ({_line_sql('tgt_tok')})
        SELECT sample_id, s.line_md5 AS src_md5, t.line_md5 AS tgt_md5
        FROM samples JOIN s USING (row_idx) JOIN t USING (row_idx)""",
    "paired_rows_limited": f"""WITH {BOTH},{PAIRS}
        SELECT split_idx AS sample_id, s.n AS n_src, t.n AS n_tgt
        FROM corpus JOIN src_len s USING (row_idx) JOIN tgt_len t USING (row_idx)
        WHERE split = 'validation' AND split_idx < {LIMIT} AND s.n >= 10 AND t.n >= 10""",
    "tokenise_extended": rf"""{_S},
        items AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
          FROM (SELECT item_id, regexp_extract_all(text, '\S+') AS w FROM benchmark)),
        begins AS (SELECT item_id, pos, k, substr(word, 1, k) AS token FROM items, (VALUES (2), (3)) v(k)
          WHERE length(word) >= 4),
        firsts AS (SELECT token, min((item_id, pos, k)) AS first_at FROM begins
          WHERE token NOT IN (SELECT token FROM src_vocab) GROUP BY token),
        ext AS MATERIALIZED (SELECT token,
          (SELECT max(token_id) FROM src_vocab) + row_number() OVER (ORDER BY first_at) AS token_id FROM firsts),
        pat AS MATERIALIZED (SELECT string_agg(regexp_escape(token), '|' ORDER BY length(token) DESC, token) AS p FROM ext),
        sliced AS MATERIALIZED (SELECT row_idx, string_split_regex(text, p) AS gap, regexp_extract_all(text, p) AS found
          FROM corpus, pat),
        pieces AS (SELECT row_idx, i, list_concat(regexp_extract_all(gap[i], '\S+'),
            CASE WHEN i <= len(found) THEN [found[i]] ELSE [] END) AS w
          FROM (SELECT *, unnest(range(1, len(gap) + 1)) AS i FROM sliced)),
        each AS (SELECT row_idx, i, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM pieces),
        every AS (SELECT token, token_id FROM src_vocab UNION ALL SELECT token, token_id FROM ext)
        SELECT row_idx, count(*) AS n_tokens,
          md5(string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY i, place)) AS line_md5
        FROM each JOIN every USING (token) GROUP BY row_idx""",
    "paired_training_rows": f"""WITH {BOTH},{PAIRS}
        SELECT split_idx AS sample_id, s.n AS n_src, t.n AS n_tgt
        FROM corpus JOIN src_len s USING (row_idx) JOIN tgt_len t USING (row_idx)
        WHERE split = 'train' AND s.n >= 10 AND t.n >= 10""",
    "line_round_trip": f"""{_T} SELECT row_idx, count(*) AS n, CAST(sum(token_id) AS BIGINT) AS id_sum
        FROM tgt_tok GROUP BY row_idx""",
    "vocabulary_overlap": f"WITH {BOTH},{OVERLAP} SELECT tgt_id, src_id FROM overlap",
    "overlap_ratio": f"""WITH {BOTH},{OVERLAP}
        SELECT (SELECT count(*) FROM overlap) AS n_overlap, count(*) AS n_vocab,
          round((SELECT count(*) FROM overlap) * 100.0 / count(*), 6) AS percent FROM tgt_vocab""",
}
