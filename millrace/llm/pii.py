"""Personal data in texts, disguised or not, with spans in the original text.

Plain identifiers are found in the text itself. Then a chain of transducers rewrites disguises (look-alike letters, full-width
and other digits, invisible characters, digits and "plus" in words, "at" and "dot" in words or brackets), keeping for each
rewritten character the span that it came from; identifiers found in the rewritten text are mapped back to the source.
Plain spans stay as they are; a disguised one counts if it uses a rewritten character and meets no plain one of its kind.

Matches of each kind are leftmost and don't overlap; those that fail their test are dropped without a retry. Every
search is linear in the text, long runs included.

Not found, by design: a spoken "at" before a domain without a disguised dot ("jane at example.com", which "look at
example.com" could be as well), digits of other languages in words, and identifiers cut by line ends.

Defined cases: a null text is empty; repeated rows are searched each; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import map_batches

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is tried at its beginning only: a later start fails as the first does
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# fixed values: letters of other scripts that look like ASCII ones, in the order of their code points
_LOOKALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "﹒": ".", "﹫": "@",
}
_INVISIBLE = "­​‌‍⁠﻿"
# fixed values: digits in words
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_SINGLE = re.compile(f"[{''.join(_LOOKALIKE)}{_INVISIBLE}！-～]|(?![0-9])\\d")
_OPEN, _SHUT = r"[\x20\t]*[\[({<][\x20\t]*", r"[\x20\t]*[\])}>][\x20\t]*"
_NAME = "[A-Za-z0-9-]+"
_BRACKETED = re.compile(rf"(?i){_OPEN}(?:(at|@)|(dot|\.))(?![A-Za-z0-9]){_SHUT}")
_SPOKEN_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9])[\x20\t]+dot[\x20\t]+(?=[A-Za-z0-9])")
#: " at " in words counts only before a domain of which at least one dot is itself disguised.
_SPOKEN_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9])[\x20\t]+at[\x20\t]+(?={_NAME}(?:\.{_NAME})*(?:[\x20\t]+dot[\x20\t]+|{_OPEN}(?:dot|\.){_SHUT}){_NAME})")
_SPOKEN_DIGIT = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:plus(?=[\x20-]*(?:[0-9]|(?:{'|'.join(_SPELLED)})(?![A-Za-z0-9])))|(?:{'|'.join(_SPELLED)})(?![A-Za-z0-9]))")
_AFTER_PLUS = re.compile(r"(?<=\+)[\x20-]+(?=[0-9])")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                last = m.end()
                at = text.find("@", last)
                continue
        at = text.find("@", at + 1)
    return out


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """The plain identifiers of each kind, as (start, end) in code points, end exclusive."""
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


class Tape:
    """A text under rewriting; for each character the source span it came from, and whether a transducer wrote it.

    The spans exist from the first rewritten character on; a text that no transducer rewrites costs its searches only.
    """

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] = []
        self.end: list[int] = []
        self.new: list[bool] = []

    def rewrite(self, pattern: re.Pattern, to) -> None:
        parts, start, end, new, at = [], [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            if a == b:
                continue
            if not self.new:
                self.start, self.end, self.new = list(range(len(self.text))), list(range(1, len(self.text) + 1)), [False] * len(self.text)
            out = to(m)
            parts += [self.text[at:a], out]
            start += [*self.start[at:a], *[self.start[a]] * len(out)]
            end += [*self.end[at:a], *[self.end[b - 1]] * len(out)]
            new += [*self.new[at:a], *[True] * len(out)]
            at = b
        if at:
            parts.append(self.text[at:])
            self.text = "".join(parts)
            self.start, self.end, self.new = start + self.start[at:], end + self.end[at:], new + self.new[at:]


def _plain_character(m: re.Match) -> str:
    c = m[0]
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return str(unicodedata.decimal(c))


def rewritten(text: str) -> Tape:
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(_SINGLE, _plain_character)
    tape.rewrite(_SPOKEN_AT, lambda m: "@")
    tape.rewrite(_BRACKETED, lambda m: "@" if m[1] else ".")
    tape.rewrite(_SPOKEN_DOT, lambda m: ".")
    tape.rewrite(_SPOKEN_DIGIT, lambda m: _SPELLED.get(m[0].lower(), "+"))
    tape.rewrite(_AFTER_PLUS, lambda m: "")
    return tape


def find_all(text: str | None, wider: bool = False) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(plain spans, all spans) of each kind, in order of their start.

    ``wider``: disguised spans that meet a plain one of their kind and reach beyond it are given as well.
    """
    text = text or ""
    base = find(text)
    everything = {k: list(v) for k, v in base.items()}
    tape = rewritten(text)
    if tape.text != text:
        for kind, spans in find(tape.text).items():
            plain, i = base[kind], 0
            for a, b in spans:
                start, end = tape.start[a], tape.end[b - 1]
                while i < len(plain) and plain[i][1] <= start:
                    i += 1
                clear = i == len(plain) or end <= plain[i][0]
                # a character may also have gone (an invisible one), so that the match is shorter than its source
                beyond = wider and not clear and (start < plain[i][0] or end > plain[i][1])
                if (clear or beyond) and (end - start > b - a or any(tape.new[a:b])):
                    everything[kind].append((start, end))
            everything[kind].sort()
    return base, everything


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone long, base_sha256, spans string) for each row; counts are of all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [find_all(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([len(every[k]) for _, every in got], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([joined(e) for _, e in got], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask_text(text: str) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first, then the longest, counts.

    Where a disguise reaches beyond a plain identifier ("john dot smith@example.com"), all of it goes.
    """
    _, every = find_all(text, wider=True)
    parts, at = [], 0
    for a, _, kind, b in sorted((a, -b, k, b) for k in KINDS for a, b in every[k]):
        if a >= at:
            parts += [text[at:a], f"[{kind}]"]
            at = b
        elif b > at:  # what sticks out of an earlier span goes as well
            at = b
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` (all rows and columns) with personal data masked, and its length renewed where there is a column for it."""
    names = docs.columns
    t, n = names.index(text_col), names.index(length_col) if length_col in names else None
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            texts = [None if x is None else mask_text(x) for x in batch.column(t).to_pylist()]
            cols[t] = pa.array(texts, batch.schema.field(t).type)
            if n is not None:
                cols[n] = pa.array([None if x is None else len(x) for x in texts], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return map_batches(docs, run, schema)
