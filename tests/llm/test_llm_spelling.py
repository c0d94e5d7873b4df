"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from vocabbridge.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for word, others in around.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[word] = best if best and words[best] >= 10 * words[word] else None
    out = []
    for word, n in words.items():
        root = word
        while form[root]:
            root = form[root]
        out.append((word, form[word], root, n, len(around[word]), words.get(form[word])))
    return sorted(out)


def edited(draw, word):
    at = draw.randrange(len(word))
    kind = draw.randrange(3)
    if kind == 0:
        return word[:at] + word[at + 1 :]
    letter = draw.choice("abcdeéñÿAZ")
    return word[:at] + letter + word[at + (kind == 1) :]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_words_and_forms(make_docs, seed):
    draw = random.Random(seed)
    letters = "ab" if seed == 1 else "abcdeéñ"
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(7, 9 + seed))) for _ in range(25)]
    words += ["a" * 8, "a" * 9, "a" * 7 + "b", "ab" * 5, "aabbaabb"]
    texts = [None, "", "12 _ ÷×÷×÷×÷ short aaaaaaa", "x" * 300 + " " + "x" * 299 + "y " + "x" * 300]
    for _ in range(60):
        chosen = [w for w in words for _ in range(draw.choice([0, 1, 6]))]
        chosen += [edited(draw, draw.choice(words)) for _ in range(30)]
        chosen += [edited(draw, edited(draw, words[n % 3])) for n in range(9)]
        draw.shuffle(chosen)
        texts.append(draw.choice([" ", ", ", "1"]).join(w.upper() if draw.random() < 0.1 else w for w in chosen))
    ids = [*range(len(texts) - 3), None, 3, 3]
    rows = list(zip(ids, texts, strict=True))
    got = spelling.spelling_variants(make_docs(texts, ids))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = brute(rows)
    assert sorted(map(tuple, got.collect())) == expected


def test_no_words(make_docs):
    assert spelling.spelling_variants(make_docs([])).count() == 0
    assert spelling.spelling_variants(make_docs([None, "", "once upon"])).count() == 0


def test_chains_of_forms(make_docs):
    texts = ["abcdefg " * 2000, "abcdefgh " * 200, "abcdefghi " * 20, "abcdefghij " * 2]
    got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(make_docs(texts)).collect()}
    assert got["abcdefghij"] == ("abcdefghi", "abcdefg")
    assert got["abcdefg"] == (None, "abcdefg")


def test_pivots_are_the_cheapest_disjoint_pair():
    draw = random.Random(8)
    for _ in range(300):
        word = "".join(draw.choice("abc") for _ in range(draw.randint(7, 12)))
        ranks = {a + b: (draw.randint(1, 9), a + b) for a in "abc" for b in "abc"}
        places = spelling.gram_prefix(word, ranks)
        cost = lambda i: ranks[word[i : i + 2]][0]  # noqa: B023, E731
        pairs = [(i, j) for i in places for j in places if j >= i + 2]
        first, second = spelling.pivots(word, places, ranks)
        assert second >= first + 2
        assert cost(first) + cost(second) == min(cost(i) + cost(j) for i, j in pairs)


def test_query(spark):
    from vocabbridge.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_spelling(spark, folder).collect())) == brute(rows)
