"""Words of many texts as arrays: a task's texts are cut and hashed together by numpy, never word by word.

A word is a run of characters outside the ASCII white space and ``SIGNS``, in lower case:
marks alone, such as the bars of a table's row, are no words. Lines of marks alone are
cut apart from the others, at white space only (``mark_lines``).
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Signs that count as space: ASCII's punctuation and symbols.
SIGNS = string.punctuation
#: Bytes of text that a task cuts at a time (one text at least).
SLICE = 1 << 21
U64 = np.uint64
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)

_GAP = np.zeros(256, bool)
_GAP[list(b" \t\n\x0b\x0c\r" + SIGNS.encode())] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _hashed(text: bytes, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range, eight at a time. ``text`` has eight bytes more than the last range."""
    # An overlapping view: eight bytes from any place on as one number.
    eight = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    out, left, at = width.astype(U64) * M3, width, begin
    rest = np.arange(len(begin))
    while len(rest):
        piece = eight[at] & _FIRST[np.minimum(left, 8)]
        out[rest] = mixed((out[rest] if len(rest) < len(out) else out) + piece * M1)
        more = np.flatnonzero(left > 8)
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    return out


class Lines(NamedTuple):
    """The lines of some texts that have a word."""

    text: np.ndarray  # number of the text
    line: np.ndarray  # number of the line in its text
    first: np.ndarray  # place of the line's first word
    size: np.ndarray  # words of the line
    hash: np.ndarray  # of every word
    width: np.ndarray  # bytes of every word

    def part(self, a: int, b: int) -> Lines:
        """Lines a to b."""
        lo = int(self.first[a])
        hi = int(self.first[b - 1] + self.size[b - 1])
        return Lines(self.text[a:b], self.line[a:b], self.first[a:b] - lo, self.size[a:b], self.hash[lo:hi], self.width[lo:hi])


def _runs(buf: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the runs outside ``gap``, and the number of runs before each line, and in all."""
    inside = np.zeros(len(buf) + 2, bool)
    np.logical_not(gap[buf], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    return begin, end, np.concatenate([[0], np.searchsorted(begin, np.flatnonzero(buf == 10)), [len(begin)]])


def _raw(texts: list[str]) -> tuple[bytes, np.ndarray]:
    raw = b"\n".join([*(t.lower().encode() for t in texts), b" " * 7])
    return raw, np.frombuffer(raw, np.uint8)[:-8]


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every line the number of its text and its own in the text."""
    lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), lines)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(lines) - lines, lines)


def lines_of(texts: list[str]) -> Lines:
    raw, buf = _raw(texts)
    begin, end, at = _runs(buf, _GAP)
    size = np.diff(at)
    text, line = _numbered(texts)
    told = np.flatnonzero(size)
    return Lines(text[told], line[told], at[told], size[told], _hashed(raw, begin, end - begin), end - begin)


def mark_lines(texts: list[str]) -> Lines:
    """The lines that have marks and no word; runs of marks stand for their words."""
    raw, buf = _raw(texts)
    begin, end, at = _runs(buf, _SPACE)
    size = np.diff(at)
    told = (size > 0) & (np.diff(_runs(buf, _GAP)[2]) == 0)
    kept = np.repeat(told, size)
    begin, end, size = begin[kept], end[kept], size[told]
    text, line = _numbered(texts)
    return Lines(text[told], line[told], np.cumsum(size) - size, size, _hashed(raw, begin, end - begin), end - begin)


def slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of an Arrow column, about SLICE bytes at a time, with the place of the first."""
    upto = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(upto):
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + SLICE, "right")))
        yield start, column.slice(start, end - start).to_pylist()
        start = end


def keys(x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each line's words in their order, as two columns."""
    place = np.arange(len(x.hash)) - np.repeat(x.first, x.size)
    z = mixed(x.hash + place.astype(U64) * M1)
    return np.add.reduceat(z, x.first), np.add.reduceat(mixed(z ^ M2), x.first)


def counted(x: Lines) -> np.ndarray:
    """A hash of every word with its number among its equals in the line, so that the lines are sets. In each line's range, in any order."""
    line = np.repeat(np.arange(len(x.size), dtype=U64), x.size)
    h = x.hash[np.argsort((line << U64(48)) | (x.hash >> U64(16)))]
    begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])])) if len(h) else np.empty(0, np.int64)
    nth = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    return h + nth.astype(U64) * M1


def parity(x: Lines) -> np.ndarray:
    """48 bits: whether the counted words of each of 48 classes are odd in number. n edits change 2 n bits at most."""
    return np.bitwise_xor.reduceat(U64(1) << ((counted(x) >> U64(20)) % U64(48)), x.first)


def simhash(x: Lines) -> np.ndarray:
    """64 bits: each set where it is set in more than half of the line's word hashes."""
    bits = np.unpackbits(x.hash.view(np.uint8)).view(U64).reshape(-1, 8)
    # Eight counters share a number; sums of at most 255 words stay within a byte.
    pieces = -(-x.size // 255)
    head = np.cumsum(pieces) - pieces
    start = np.repeat(x.first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(head, pieces))
    sums = np.add.reduceat(bits, start, axis=0).view(np.uint8)
    if len(head) < len(start):
        sums = np.add.reduceat(sums, head, axis=0, dtype=np.int32)
    return np.packbits(2 * sums.astype(np.int32) > x.size[:, None], axis=1).view(U64).ravel()


def grams(x: Lines, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, hash, bytes) of every run of ``size`` words that lies in one line."""
    line = np.repeat(np.arange(len(x.size)), x.size)
    m = max(0, len(line) - size + 1)
    inside = np.flatnonzero(line[:m] == line[size - 1 : size - 1 + m])
    h, width = np.full(len(inside), size, U64), np.zeros(len(inside), np.int64)
    for k in range(size):
        h = h * (M1, M2, M3)[k % 3] + x.hash[inside + k]
        width += np.minimum(x.width[inside + k], 40)
    return line[inside], mixed(h), width
