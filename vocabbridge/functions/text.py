"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The two built-in word tokenisers.
WORDS = r"\S+"
WORDS_AND_MARKS = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"

# Branches of a pattern that are tried one after the other.
FEW_BRANCHES = 4


def strip(text: Column) -> Column:
    """Trim all Unicode white space; a null counts as the empty string."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(STRIP_CHARS))


def words(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` in reading order, over the whole text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def cut_pattern(tokens: list[str]) -> str:
    """A pattern that finds any of ``tokens``, the longest one at its place.

    The tokens are put into a trie, and the trie is written as nested groups: a text is
    followed down one path, however many tokens there are.  A node where a token ends
    makes what follows it optional, and optional parts are taken where they fit, so the
    longest token wins.  The branches of a node begin with different characters: those that
    end there are one class, and many branches are halved by the next character, again and
    again, instead of being tried one after the other.
    """
    trie: dict = {}
    for token in tokens:
        node = trie
        for char in token:
            node = node.setdefault(char, {})
        node[""] = {}

    def choose(branches: list[tuple[str, str]]) -> str:
        if len(branches) <= FEW_BRANCHES:
            return "|".join(written for _, written in branches)
        half = len(branches) // 2
        left, right = branches[:half], branches[half:]
        return f"(?=[{''.join(chars for chars, _ in left)}])(?:{choose(left)})|{choose(right)}"

    def write(node: dict) -> str:
        after = {char: write(node[char]) for char in sorted(node) if char}
        last = "".join(_literal(char) for char, rest in after.items() if not rest)
        branches = [(_literal(char), _literal(char) + rest) for char, rest in after.items() if rest]
        branches += [(last, f"[{last}]")] if last else []
        if not branches:
            return ""
        if len(branches) == 1 and "" not in node:
            return branches[0][1]
        return "(?:" + choose(branches) + ")" + ("?" if "" in node else "")

    if not trie or "" in trie:
        raise ValueError("added tokens must not be empty")
    return write(trie)


def _literal(char: str) -> str:
    return "\\" + char if ord(char) < 128 and not char.isalnum() else char


def words_and_added(text: Column, pattern: str, added: list[str]) -> Column:
    """The words of the text, after the ``added`` tokens have been cut out of it.

    Added tokens are found from left to right, the longest first, wherever they stand; only
    what lies between them is split by ``pattern``.
    """
    if not added:
        return words(text, pattern)
    cut = F.lit(cut_pattern(added))
    parts = F.arrays_zip(F.split(text, cut, -1).alias("between"), F.regexp_extract_all(text, cut, F.lit(0)).alias("token"))
    return F.flatten(
        F.transform(parts, lambda p: F.concat(words(p["between"], pattern), F.array_compact(F.array(p["token"]))))
    )


def text_to_json(text: Column) -> Column:
    """One ``{"text": ...}`` object, non-ASCII characters kept as they are."""
    return F.to_json(F.struct(text.alias("text")))
