"""Secret scan: fixed patterns, and a lexer for assignments.

The patterns find ``keyword = value`` assignments, access key ids and long hexadecimal
runs.  The lexer looks at every ``=``, ``:``, ``:=`` and ``=>`` of a text, reads the name
before and the expression after it (a quoted literal, a bare word, a name, or a sum of
them), keeps what each name stands for, and so follows constants through names.  A
literal is a secret if the name it ends up in is sensitive enough for its looks.

Nulls and edges: a null text is empty.  Whole texts are read.  Offsets count code
points, ends are exclusive.  Repeated rows give repeated results; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the base scan and the least lengths of what they match.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "literal")

# How much a part of a target name says that its value is secret.
NAME_SCORES = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "privatekey": 3,
    "apikey": 3, "credential": 3, "credentials": 3, "token": 2, "pass": 2, "auth": 2, "key": 1,
    "private": 1, "access": 1, "client": 1, "api": 1, "signing": 1, "encryption": 1, "bearer": 2,
}
# Words of a name that say the value is about a secret, not one.
NAME_DENIES = {"name", "id", "path", "file", "url", "uri", "length", "len", "size", "type", "count", "hint", "public", "limit"}
LEAST_SCORE = 5
LEAST_LITERAL = 8
PLACEHOLDER = re.compile(r"(?i)example|changeme|change_me|your[_-]|placeholder|xxxx|\*\*\*|\$\{|dummy|redacted")

_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_SIGN = re.compile(r":=|=>|[=:]")
_ITEM = re.compile(
    r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z_][A-Za-z0-9_.]*(?![A-Za-z0-9+/=_-]))|([A-Za-z0-9+/_.=@!#$%^&*-]+))"""
)
_PLUS = re.compile(r"[ \t]*\+(?!=)")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# Kinds of characters, and what a value keeps of its ends: more than any placeholder's length.
_KINDS = tuple(re.compile(p) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
_DIGIT, _BLANK, _FEW, VARIED = 2, re.compile(r"\s"), 24, 6


# What a match cannot do without, for a quick look before the patterns run.
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_HEX_DIGITS = bytes(49 if chr(i) in "0123456789abcdef" else 48 for i in range(256))
_HEX_RUN = b"1" * 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found: list[tuple[int, int, int]] = []
    letters = text.encode("ascii", "replace")
    if "=" in text or ":" in text:
        lower = letters.lower()
        if any(word in lower for word in _KEYWORDS):
            found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _HEX_RUN in letters.translate(_HEX_DIGITS):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def name_score(name: str) -> int:
    """How sensitive a target name is; 0 if a part of it denies that."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or parts[-1] in NAME_DENIES:
        return 0
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return min(4, sum(NAME_SCORES.get(p, 0) for p in parts + joined))


class Value:
    """What a name stands for: a literal, or literals put together.

    Parts are kept by reference, and what the score needs to know is added up, so a value
    takes the same little memory whatever its length.
    """

    __slots__ = ("parts", "span", "length", "kinds", "letters", "blank", "dummy", "opens", "closes", "head", "tail", "told")

    def __init__(self, text: str = "", span: tuple[int, int] | None = None):
        self.parts, self.span, self.told = (), span, False
        self.length = len(text)
        self.kinds = frozenset(n for n, kind in enumerate(_KINDS) if kind.search(text))
        self.letters = frozenset(text[:_FEW]) if len(set(text[:_FEW])) >= VARIED else frozenset(text)
        self.blank, self.dummy = bool(_BLANK.search(text)), bool(PLACEHOLDER.search(text))
        first, last = text.find("<"), text.rfind(">")
        self.opens, self.closes = first >= 0, last >= 0
        self.dummy |= 0 <= first < last
        self.head, self.tail = text[:_FEW], text[-_FEW:]

    def then(self, other: Value) -> Value:
        """This value followed by another one."""
        out = Value()
        out.parts = (self, other)
        out.length = self.length + other.length
        out.kinds = self.kinds | other.kinds
        out.letters = self.letters if len(self.letters) >= VARIED else self.letters | other.letters
        out.blank = self.blank or other.blank
        out.dummy = self.dummy or other.dummy or (self.opens and other.closes)
        out.dummy = out.dummy or bool(PLACEHOLDER.search(self.tail + other.head))
        out.opens, out.closes = self.opens or other.opens, self.closes or other.closes
        out.head = (self.head + other.head)[:_FEW]
        out.tail = (self.tail + other.tail)[-_FEW:]
        return out

    def score(self) -> int:
        """How much the value looks like a secret: length and kinds of characters."""
        if self.length < LEAST_LITERAL or self.dummy or self.blank or len(self.kinds) < 2:
            return 0
        return (len(self.letters) >= VARIED) + (_DIGIT in self.kinds) + (self.length >= 16)

    def tell(self, found: set[tuple[int, int, int]]) -> None:
        """Add the spans of all literals; each value does so once."""
        todo = [self]
        while todo:
            value = todo.pop()
            if not value.told:
                value.told = True
                todo += value.parts
                if value.span is not None and value.length:
                    found.add((value.span[0], 3, value.span[1]))


def name_before(text: str, end: int, least: int) -> str | None:
    """The name that ends at ``end``, but for blanks, a bracket and a quote."""
    while end > least and text[end - 1] in " \t":
        end -= 1
    if end > least and text[end - 1] == "]":
        end -= 1
    if end > least and text[end - 1] in "\"'":
        end -= 1
    begin = end
    while begin > least and text[begin - 1] in _NAME_CHARS:
        begin -= 1
    name = text[begin:end].lstrip("0123456789.-")
    return name or None


def assignments(text: str):
    """(name, items) per assignment; an item is (kind, word, start, end).

    The kinds are literal, bare (a word that is a name or a value) and name (one that
    stands in a sum or is called, so it is no value itself).
    """
    taken = 0
    for sign in _SIGN.finditer(text):
        if sign.start() < taken:
            continue
        name = name_before(text, sign.start(), taken)
        if not name:
            continue
        at, items, last_quoted = sign.end(), [], False
        while item := _ITEM.match(text, at):
            group = item.lastindex
            kind = "bare" if group == 3 else "literal"
            items.append((kind, item[group], item.start(group), item.end(group)))
            at, last_quoted = item.end(), group < 3
            plus = _PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        if items:
            if len(items) > 1 or text[at : at + 1] in ("(", "["):
                items = [("name" if kind == "bare" else kind, *rest) for kind, *rest in items]
            taken = at if last_quoted or len(items) > 1 else sign.end()
            yield name, items


def lexed_spans(text: str) -> set[tuple[int, int, int]]:
    """(start, kind, end) of the literals that sensitive names stand for.

    A name that is assigned again stands for its last value.
    """
    found: set[tuple[int, int, int]] = set()
    if "=" not in text and ":" not in text:
        return found
    known: dict[str, Value] = {}
    for name, items in assignments(text):
        value = None
        for kind, word, start, end in items:
            if kind != "literal" and word in known:
                part = known[word]
            elif kind == "name":
                continue  # nothing is known of it, and it is no literal
            else:
                part = Value(word, (start, end))
            value = part if value is None else value.then(part)
        if value is None:
            known.pop(name, None)
            continue
        known[name] = value
        score = name_score(name)
        if score and score + value.score() >= LEAST_SCORE:
            value.tell(found)
    return found


def outside(spans: set[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that lie in none of the base spans; both are swept in order."""
    out, place, reach = [], 0, -1
    for span in sorted(spans):
        while place < len(base) and base[place][0] <= span[0]:
            reach = max(reach, base[place][2])
            place += 1
        if span[2] > reach:
            out.append(span)
    return out


def digest(text: str) -> tuple[int, int, int, str, str]:
    """The counts, the hash of the base spans, and all spans of one text."""
    base = sorted(base_spans(text))
    extra = outside(lexed_spans(text), base)
    written = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
    spans = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + extra))
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return (*counts, hashlib.sha256(written.encode()).hexdigest(), spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""

    def run(batches):
        for batch in batches:
            rows = [digest(x or "") for x in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    columns = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = columns.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return columns.mapInArrow(run, schema)


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per span: ``doc_id, kind, start, end``."""
    span = F.explode(F.split(F.col("spans"), ","))
    parts = F.split("span", ":")
    rows = scan(docs, doc_id, text).where("spans <> ''").select("doc_id", span.alias("span"))
    return rows.select("doc_id", parts[0].alias("kind"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"))
