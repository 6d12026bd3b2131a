"""Personal data with offset-preserving deobfuscation.

A transducer rewrites a text and keeps, for every character it puts out, the range of
source characters that it came from. Three run in a row: homoglyphs (letters, digits
and signs that look like ASCII ones), spelled digits ("plus four five double-two"), and
at/dot disguises ("name [at] host dot org"). The detectors run over the source and
over the rewritten text; spans of the latter are mapped back to source characters.

Kinds and their checks: email; ip (parts up to 255); card (14 to 19 digits, Luhn);
phone (10 to 15 digits). The base spans are the leftmost non-overlapping matches of
each kind's pattern in the source that pass the check. The method only adds spans: one
from the rewritten text counts if it overlaps no base span of its kind.

A null text is empty and holds nothing. Rows are independent, so repeated rows give
repeated results; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # A run of digits is entered at its start only: what fails there fails further on.
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in found.split("."))
    digits = re.sub("[^0-9]", "", found)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


#: What must be there before a pattern can match; searching for it is much cheaper.
DIGIT = re.compile(r"[0-9]")
HINTS = {"ip": re.compile(r"[0-9]\.[0-9]"), "card": re.compile(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": re.compile(r"\+[0-9]")}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's leftmost non-overlapping matches, looking only near each at sign.

    A match has exactly one "@" and starts where the run of local characters before
    it starts, or where the match before it ended.
    """
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        begin = at
        while begin > done and (c := text[begin - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            begin -= 1
        m = PATTERNS["email"].match(text, begin) if begin < at else None
        if m:
            yield m.span()
            done = m.end()
        at += 1


def detect(text: str) -> list[Span]:
    found = [Span(a, 0, b) for a, b in _emails(text)]
    if not DIGIT.search(text):
        return found
    for k, kind in enumerate(KINDS[1:], 1):
        if HINTS[kind].search(text):
            found += [Span(m.start(), k, m.end()) for m in PATTERNS[kind].finditer(text) if valid(kind, m[0])]
    return sorted(found)


# Letters and signs that look like ASCII ones, per ASCII character.
LOOKALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іι", "j": "ј", "k": "κк",
    "l": "ⅼ", "m": "ⅿ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υս", "v": "ѵν",
    "w": "ԝ", "x": "хχ", "y": "уγ", "z": "ᴢ", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ",
    "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ",
    "Z": "Ζ", ".": "․。｡", "-": "‐‑‒–—−", "@": "﹫", "+": "﹢", " ": "    ", "": "​‌‍⁠﻿­",
}
#: First code points of runs in the order of ASCII: full-width signs, then digits of mathematical styles, subscripts and other scripts.
RUNS = ((0xFF01, 0x21, 94), (0x1D7CE, 0x30, 10), (0x1D7D8, 0x30, 10), (0x1D7E2, 0x30, 10), (0x1D7EC, 0x30, 10), (0x1D7F6, 0x30, 10), (0x2080, 0x30, 10), (0x0660, 0x30, 10), (0x06F0, 0x30, 10), (0x0966, 0x30, 10))
GLYPHS = {ord(c): a for a, cs in LOOKALIKES.items() for c in cs}
GLYPHS |= {first + i: chr(to + i) for first, to, n in RUNS for i in range(n)}
GLYPH_CLASS = re.compile("[" + "".join(map(re.escape, map(chr, sorted(GLYPHS)))) + "]")

# The words for digits in four languages.
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
}
TIMES = {"double": 2, "triple": 3}
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_ITEM = rf"(?:(?:{'|'.join(TIMES)})[ -])?{_WORD}\b|[0-9]+\b"
#: At least three items with one spelled digit or a spelled plus among them; a sign between items stays. For folded text.
SPELLED = re.compile(rf"(?<!\w)(?:plus[ ,-]{{1,2}})?(?:{_ITEM})(?:[ ,-]{{1,2}}(?:{_ITEM})|[ ]?(?:\.|dot|point)[ ]?(?:{_ITEM})){{2,}}")
SPELLED_PART = re.compile(rf"(?P<plus>plus[ ,-]{{1,2}})|(?:(?P<times>{'|'.join(TIMES)})[ -])?(?P<word>{_WORD})\b|(?P<digits>[0-9]+)|(?P<dot>[ ]?(?:\.|dot|point)[ ]?)|(?P<gap>[ ,-]+)", re.I)

_AT = r"\s*[\[({<]\s*(?:at|arroba|@)\s*[\])}>]\s*|\s+(?:at|arroba)\s+|\s+@\s*|@\s+"
_DOT = r"\s*[\[({<]\s*(?:dot|punto|point|punkt|\.)\s*[\])}>]\s*|\s+(?:dot|punto|point|punkt)\s+"
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_%+-")
DOT_WORDS = ("dot", "punto", "point", "punkt")
#: After a name, an at sign in some guise, and a host whose parts meet at dots in some guise. For folded text.
AT_HOST = re.compile(rf"(?<=[a-z0-9_%+-])(?P<at>@|{_AT})(?P<host>[a-z0-9-]++(?:(?:\.|{_DOT})[a-z0-9-]+)+)")
#: After a plain "at", the host of an address with plain dots.
PLAIN_HOST = re.compile(r"at\s+[A-Za-z0-9-]+\.[A-Za-z0-9-]", re.I)
#: Words of which an address in disguise has one, if it has no sign and no plain "at".
SIGN_WORDS = ("dot", "punto", "point", "punkt", "arroba")
#: Letters that the patterns take for i, s and k, besides their own lower case.
FOLDED = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")


def folded(text: str) -> str:
    """In lower case, as the patterns compare letters."""
    return text.lower() if text.isascii() else text.translate(FOLDED).lower()


DOTS = re.compile(rf"\.|{_DOT}", re.I)


class Rewritten:
    """A text with, for every character, the source range it came from."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] | range = range(len(text))
        self.end: list[int] | range = range(1, len(text) + 1)

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges (ascending, apart); each new character comes from the whole range it replaces."""
        if not edits:
            return
        text, starts, ends, done = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[done:a])
            starts += self.start[done:a]
            ends += self.end[done:a]
            if new:
                text.append(new)
                starts += [self.start[a]] * len(new)
                ends += [self.end[b - 1]] * len(new)
            done = b
        self.text, self.start, self.end = "".join(text), starts, ends

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def homoglyphs(text: str) -> list[tuple[int, int, str]]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        pass
    else:
        if "\xad" not in text and "\xa0" not in text:
            return []
    return [(m.start(), m.end(), GLYPHS[ord(m[0])]) for m in GLYPH_CLASS.finditer(text)]


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    for run in SPELLED.finditer(folded(text)):
        parts = list(SPELLED_PART.finditer(text, run.start(), run.end()))
        if not any(p["word"] or p["plus"] for p in parts):
            continue
        for p in parts:
            if p["word"]:
                edits.append((p.start(), p.end(), str(DIGIT_WORDS[folded(p["word"])]) * TIMES.get(folded(p["times"] or ""), 1)))
            elif p["plus"]:
                edits.append((p.start(), p.end(), "+"))
            elif p["dot"]:
                edits.append((p.start(), p.end(), "."))
            elif p["gap"]:
                edits.append((p.start(), p.end(), "-" if "-" in p[0] else ""))
    return edits


def _before_space(low: str, end: int) -> int:
    while end and low[end - 1].isspace():
        end -= 1
    return end


def _dot_before(low: str, end: int) -> int:
    """Where the dot in some guise that ends at ``end`` begins; -1 if there is none."""
    if end and low[end - 1] == ".":
        return end - 1
    at = _before_space(low, end)
    bracketed = at > 0 and low[at - 1] in "])}>"
    if not bracketed and at == end:
        return -1
    at = _before_space(low, at - 1) if bracketed else at
    size = next((len(w) for w in (*DOT_WORDS, *(["."] if bracketed else [])) if low.endswith(w, 0, at)), 0)
    if not size:
        return -1
    begin = _before_space(low, at - size)
    if bracketed:
        return _before_space(low, begin - 1) if begin and low[begin - 1] in "[({<" else -1
    return begin if begin < at - size else -1


def _name_before(low: str, end: int, done: int) -> int:
    """The first place, not before ``done``, where a name of parts and dots that ends at ``end`` may begin; -1 if none."""
    first = -1
    while True:
        begin = end
        while begin > done and low[begin - 1] in NAME_CHARS:
            begin -= 1
        if begin == end:
            return first
        if not begin or low[begin - 1] not in NAME_CHARS and low[begin - 1] != ".":
            first = begin
        end = _dot_before(low, begin)
        if end < 0:
            return first


def addresses(low: str) -> Iterator[tuple[int, re.Match]]:
    """Start of the name, and at sign and host, of each address, leftmost first and apart; read outward from the at signs."""
    done = pos = 0
    while m := AT_HOST.search(low, pos):
        begin = _name_before(low, m.start(), done)
        if begin < 0:
            pos = m.start() + 1
        else:
            yield begin, m
            done = pos = m.end()


def at_dot(text: str) -> list[tuple[int, int, str]]:
    """Edits that undo disguises of "@" and "." in addresses.

    A plain "at" before a host with plain dots is everyday prose ("meet at
    example.com"); it counts only if the name holds a digit or a sign.
    """
    low = folded(text)
    if not ("@" in low or any(c in low for c in "[({<") or any(w in low for w in SIGN_WORDS) or PLAIN_HOST.search(low)):
        return []
    edits: list[tuple[int, int, str]] = []
    for begin, m in addresses(low):
        host_dots = list(DOTS.finditer(text, *m.span("host")))
        if m["at"].strip().isalpha() and all(d[0] == "." for d in host_dots) and text[begin : m.start()].isalpha():
            continue
        edits += [(*d.span(), ".") for d in DOTS.finditer(text, begin, m.start())]
        edits.append((*m.span("at"), "@"))
        edits += [(*d.span(), ".") for d in host_dots]
    return [(a, b, new) for a, b, new in edits if text[a:b] != new]


def rewritten(text: str) -> Rewritten:
    out = Rewritten(text)
    if not text.isascii():
        out.apply(homoglyphs(out.text))
    out.apply(spelled_digits(out.text))
    out.apply(at_dot(out.text))
    return out


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with those that only the rewritten text shows."""
    base = detect(text)
    out = rewritten(text)
    if out.text == text:
        return base, base
    # Spans of a kind are apart and ascend, so the last one that starts before b tells.
    own = [[s for s in base if s.kind == k] for k in range(len(KINDS))]
    more = []
    for s in detect(out.text):
        a, b = out.source(s.start, s.end)
        before = bisect_left(own[s.kind], b, key=lambda o: o.start)
        if not before or own[s.kind][before - 1].end <= a:
            more.append(Span(a, s.kind, b))
    return base, sorted([*base, *more])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [all_spans(t.as_py() or "") for t in b.column(1)]
            counts = [[sum(s.kind == k for s in base) for base, _ in rows] for k in range(len(KINDS))]
            yield pa.record_batch(
                [
                    b.column(0),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                    pa.array([written(every) for _, every in rows], pa.string()),
                    pa.array([len(every) - len(base) for base, every in rows], pa.int64()),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
