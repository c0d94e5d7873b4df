import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, kept string, comp int, node string, target string"


def rows_of(texts, ids=None):
    out = []
    for i, text in enumerate(texts):
        doc_id = i if ids is None else ids[i]
        lang, source = ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3]
        out.append((doc_id, text, lang, source, None, "k", 1, "x", 2, "n", "t"))
    return out


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names the operators use themselves."""
    return lambda texts, ids=None: spark.createDataFrame(rows_of(texts, ids), SCHEMA)


@pytest.fixture(scope="session")
def words():
    draw = random.Random(4)
    return ["".join(draw.choice("abcdefghi") for _ in range(draw.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def edge_texts(words):
    """Null, empty, blank, equal but for case, non-ASCII, repeated, and very long texts."""
    draw = random.Random(5)
    long = " ".join(draw.choice(words) for _ in range(40_000))
    return [
        None, "", " \n\t ", "Same Text here", "same text HERE", "SAME TEXT HERE", "Ünï çødé 中文 😀", "ünï çødé 中文 😀",
        long, long.upper(), "x" * 20_000, "one", "dup dup dup dup dup dup", "dup dup dup dup dup dup",
        "password=abcdef123456", "\x1c\x85 odd spaces",
    ]


@pytest.fixture(scope="session")
def edge_docs(make_docs, edge_texts):
    ids = [*range(len(edge_texts)), None, None, 3]
    texts = [*edge_texts, "same text here", None, "Same Text here"]
    return make_docs(texts, ids)
