"""Personal data in texts, with offset-preserving deobfuscation.

Plain detectors find addresses, network numbers, card and phone numbers in the text as it stands. Then transducers
rewrite the text: look-alike letters and digits, invisible characters, spelled digits, and disguised at and dot
signs. Each rewriting keeps, for every character it puts out, the stretch of source characters it stands for. The
same detectors run over the rewritten text, and what they find is mapped back to source characters; it is added if
it touches something that was rewritten.

Defined results: a null text is an empty one; ids may be null or repeat, each row is handled by itself; other columns
are ignored by :func:`find` and kept by :func:`mask`; an empty table gives an empty result. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.session import ship

KINDS = ("email", "ip", "card", "phone")

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a longest run of dotted numbers: leftmost matches without overlap are its numbers taken four at a time
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

# Characters that look like an ASCII letter, digit or sign.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "ո": "n", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t",
    "υ": "u", "ε": "e", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "﹫": "@", "․": ".",
    "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
LOOK_ALIKES |= {chr(0xFEE0 + k): chr(k) for k in range(0x21, 0x7F)}  # full-width forms
LOOK_ALIKES |= {chr(first + k): str(k) for first in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)}
INVISIBLE = "­​‌‍⁠﻿"
# Digits as words, in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "deux": "2", "trois": "3", "quatre": "4",
    "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3",
    "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "un": "1",
}
# Last labels of host names that a disguise with one sign in words, or a host that begins with an article,
# must end in; a disguise with both signs ends in any letters.
ENDINGS = (
    "com org net edu gov mil int info biz io co ai app dev me tv us uk de fr es it nl eu ch at be se no fi dk pl pt ca au jp cn in br mx ru"
).split()

_ALIKE = re.compile("[" + "".join(map(re.escape, LOOK_ALIKES)) + INVISIBLE + "]")
_WORD = "(?:" + "|".join(sorted(map(re.escape, SPELLED), key=len, reverse=True)) + ")"
_SEP = r"[\x20\t\n.,()-]{1,3}"
_SPELL = re.compile(rf"(?<!\w)(?:(?:plus|\+)[\x20-]*)?(?:{_WORD}|[0-9]+)(?:{_SEP}(?:{_WORD}|[0-9]+)){{3,}}(?!\w)", re.I)
_SPELL_ONE = re.compile(rf"plus|{_WORD}", re.I)
_SPELL_HINT = re.compile(rf"(?<!\w)(?:plus)?{_WORD}(?!\w)", re.I)
_BRACKET_HINT = re.compile(r"[\[({<]\s*(?:at|dot|@|\.|punkt|punto|point|arroba|arobase|ät)\s*[\])}>]", re.I)
# white space before a sign is taken in by _tight: a pattern that begins with it would scan a long run again and again
_AT = re.compile(r"[\[({<]\s*(?:at|@|arroba|arobase|ät)\s*[\])}>]\s*", re.I)
_DOT = re.compile(r"[\[({<]\s*(?:dot|\.|punkt|punto|point)\s*[\])}>]\s*", re.I)
# a name before the sign has at most 64 characters by the mail standard, so at most 32 parts
_LOCAL = r"(?<![\w.%+-])[A-Za-z0-9_%+-]+(?:(?:\.|\s+dot\s+)[A-Za-z0-9_%+-]+){0,31}"
_PLAIN = re.compile(
    _LOCAL + r"(\s+at\s+|\s*@\s*)"
    r"[A-Za-z0-9-]+(?:(?:\.|\s+dot\s+)[A-Za-z0-9-]+)*?(?:\.|\s+dot\s+)(?:" + "|".join(ENDINGS) + r")(?![\w-])",
    re.I,
)
# both signs disguised; labels after a plain dot are taken in by the detector
_BOTH = re.compile(
    _LOCAL + r"(\s+at\s+(?!(?:the|an?)\s)|\s*@\s*)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:\s+dot\s+[A-Za-z0-9-]+)*\s+dot\s+[A-Za-z]{2,}(?![\w-])", re.I
)
_PLAIN_DOT = re.compile(r"(?<!\s)\s+dot\s+", re.I)
_NUMBER_DOT = re.compile(r"(?<=[0-9])\s+dot\s+(?=[0-9])", re.I)
_PLAIN_HINT = re.compile(r"\sdot\s|(?:\sat\s+|\s@\s*|@\s+)[A-Za-z0-9-]+\.[A-Za-z0-9-]", re.I)


def _luhn(d: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain detectors, leftmost and without overlap in each kind."""
    out = []
    if "@" in text:
        end = 0
        for m in _HOST.finditer(text):
            k = m.start()
            while k > end and text[k - 1] in _LOCAL_CHARS:
                k -= 1
            if k < m.start():
                out.append((0, k, m.end()))
                end = m.end()
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text) if "." in text else ():
            parts = m.group().split(".")
            at = m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append((1, at, at + size))
                at += size + 1
        for m in _CARD.finditer(text):
            d = _NO_DIGIT.sub("", m.group())
            if 13 <= len(d) <= 19 and _luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


class Rewritten:
    """A text with, for every character, the source stretch it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.first = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.new = bytearray(len(text))

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches (start, end, by), in order and without overlap."""
        if not edits:
            return
        text, first, end, new, at = [], [], [], bytearray(), 0
        for a, b, by in edits:
            text += (self.text[at:a], by)
            first += self.first[at:a]
            end += self.end[at:a]
            new += self.new[at:a]
            if by:
                lo, hi = self.first[a], self.end[b - 1]
                # each character keeps the whole stretch, so that a match on part of it covers all of it
                first += [lo] * len(by)
                end += [hi] * len(by)
                new += b"\1" * len(by)
            at = b
        text.append(self.text[at:])
        first += self.first[at:]
        end += self.end[at:]
        new += self.new[at:]
        self.text, self.first, self.end, self.new = "".join(text), first, end, new


def _tight(text: str, sign: re.Pattern, by: str) -> list[tuple[int, int, str]]:
    """Each sign with the white space before it (the pattern takes in what follows)."""
    edits, end = [], 0
    for m in sign.finditer(text):
        a = m.start()
        while a > end and text[a - 1].isspace():
            a -= 1
        end = m.end()
        edits.append((a, end, by))
    return edits


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELL.finditer(text):
        words = list(_SPELL_ONE.finditer(m.group()))
        for w in words:
            low = w.group().lower()
            a, b = m.start() + w.start(), m.start() + w.end()
            if low == "plus":
                while b < m.end() and text[b] in " -":
                    b += 1
                edits.append((a, b, "+"))
            else:
                # letters that fold to i and s match without regard to case
                edits.append((a, b, SPELLED[low.replace("i\u0307", "i").replace("ı", "i").replace("ſ", "s")]))
    return edits


def _signs(text: str) -> list[tuple[int, int, str]]:
    """Signs in words or between spaces; of disguises that overlap the first and longest counts."""
    edits, end = [], 0
    for m in sorted([*_PLAIN.finditer(text), *_BOTH.finditer(text)], key=lambda m: (m.start(), -m.end())):
        if m.start() < end:
            continue
        end = m.end()
        marks = [(m.start(1), m.end(1), "@")] + [(m.start() + d.start(), m.start() + d.end(), ".") for d in _PLAIN_DOT.finditer(m.group())]
        edits += sorted(marks)
    return edits


def rewrite(text: str) -> Rewritten | None:
    """The text with disguises undone, or None if it has none."""
    hidden = not text.isascii() and _ALIKE.search(text) is not None
    # tests that hold wherever the exact patterns match, made again on what the step before left
    hints = (_BRACKET_HINT, _PLAIN_HINT, _SPELL_HINT)
    if not hidden and not any(h.search(text) for h in hints):
        return None
    r = Rewritten(text)
    if hidden:
        r.apply([(m.start(), m.end(), LOOK_ALIKES.get(m.group(), "")) for m in _ALIKE.finditer(text)])
    if _BRACKET_HINT.search(r.text):
        r.apply(_tight(r.text, _AT, "@"))
        r.apply(_tight(r.text, _DOT, "."))
    if _PLAIN_HINT.search(r.text):
        r.apply(_signs(r.text))
    if _SPELL_HINT.search(r.text) and (edits := _spelled(r.text)):
        r.apply(edits)
        # digits that were words stand apart by what parted the words: close the gaps
        r.apply([(m.start(), m.end(), "") for m in re.finditer(r"(?<=[0-9+])[\x20\t\n,]+(?=[0-9])", r.text)
                 if r.new[m.start() - 1] or r.new[m.end()]])
    r.apply([(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(r.text)])
    return r


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The plain spans, and all spans with those that the rewriting adds; each ordered by kind and start."""
    base = sorted(base_spans(text))
    r = rewrite(text)
    if r is None:
        return base, base
    found = set(base)
    for kind, a, b in base_spans(r.text):
        gap = any(r.end[k] != r.first[k + 1] and r.first[k] != r.first[k + 1] for k in range(a, b - 1))
        if not gap and not any(r.new[a:b]):
            continue
        span = (kind, r.first[a], r.end[b - 1])
        if not any(k == kind and s <= span[1] and span[2] <= e for k, s, e in base):
            found.add(span)
    return base, sorted(found)


def _show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every text; counts are of the plain spans."""
    ship(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, shown = [[], [], [], []], [], []
            for x in batch.column(1):
                base, every = all_spans(x.as_py() or "")
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(_show(base).encode()).hexdigest())
                shown.append(_show(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(shown, pa.string())],
                [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(id_col, text_col).mapInArrow(kernel, f"`{id_col}` {kind}, {counts}, base_sha256 string, spans string")


def masked(text: str) -> str:
    """The text with each stretch of personal data replaced by the name of its kind in brackets."""
    spans = sorted((a, b, k) for k, a, b in all_spans(text)[1])
    out, at = [], 0
    i = 0
    while i < len(spans):
        a, b, k = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:  # overlapping finds are one stretch
            b = max(b, spans[i][1])
            i += 1
        out += (text[at:a], f"[{KINDS[k].upper()}]")
        at = b
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data masked in ``text_col`` and ``length_col``, if there, brought up to date."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([None if (t := x.as_py()) is None else masked(t) for x in batch.column(at)], batch.schema.field(at).type)
            columns = [text if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(kernel, StructType(docs.schema.fields))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(kind), F.col(length_col)))
    return out
