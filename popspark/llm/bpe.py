"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that a valid encoding of
that prefix can end with: the encoding ends in token t after prefix p if and only if
(last token of p, t) stay apart when their bytes are merged by rank. ``last_tokens``
stores that token for every prefix. The table gives the encoding of any prefix by
walking back, extends by exactly the new bytes on an append, and after an edit needs
new entries only until they agree with the old ones for as long as the longest token.

Texts split into pieces by the tokenizer's pattern; a null text is empty and has no
tokens. Rows are independent: repeated rows give repeated results and extra columns
are ignored. Surrogates can't occur in Spark strings, so every text has UTF-8 bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from popspark.llm.common import frugal

#: Pieces kept by a worker between batches; the cache starts anew when full.
CACHE_PIECES = 400_000


class PrefixEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, ranks), default=1)
        #: Finds all tokens that end at a place, longest first; bytes are searched as Latin-1 characters.
        self.ending = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.ending.add_word(b.decode("latin-1"), (i, len(b)))
        self.ending.make_automaton()
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.pieces: dict[str, str] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging by rank; used on the bytes of one or two tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _pair(self, a: int, b: int) -> bool:
        kept = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        if len(self.apart) > 2_000_000:
            self.apart.clear()
        self.apart[a, b] = kept
        return kept

    def _single(self, a: int) -> bool:
        kept = self.whole[a] = self.merged(self.bytes_of[a]) == [a]
        return kept

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> None:
        """Append to ``last`` (entry i: last token of the prefix of i bytes; entry 0 is -1) up to prefix ``stop``."""
        apart, whole, first = self.apart, self.whole, len(last)
        until = len(data) if stop is None else stop
        last += [-1] * (until + 1 - first)
        since = max(0, first - self.longest)
        for at, (token, n) in self.ending.iter(data[since:until].decode("latin-1")):
            end = since + at + 1
            if end < first or last[end] >= 0:
                continue
            before = last[end - n]
            if before >= 0:
                ok = apart.get((before, token))
                if ok is None:
                    ok = self._pair(before, token)
            elif end == n:
                ok = whole.get(token)
                if ok is None:
                    ok = self._single(token)
            else:
                ok = False
            if ok:
                last[end] = token
        if -1 in last[max(1, first) :]:
            raise ValueError("the ranks lack a single byte")

    def last_tokens(self, data: bytes) -> list[int]:
        last = [-1]
        self.extend(data, last)
        return last

    def walk(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the prefix of ``end`` bytes."""
        ids, at = [], len(last) - 1 if end is None else end
        while at:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        ids.reverse()
        return ids

    def replaced(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int], int]:
        """Bytes, table and number of entries computed after ``data[start:stop]`` became ``new``.

        Behind the edit an entry depends on the ``longest`` entries before it, so once
        that many agree with the old table, all the rest does too.
        """
        out, shift = data[:start] + new + data[stop:], start + len(new) - stop
        table, same = last[: start + 1], 0
        while len(table) <= len(out):
            at = len(table)
            self.extend(out, table, at)
            same = same + 1 if at - shift > stop + self.longest and table[at] == last[at - shift] else 0
            if same > self.longest:
                computed = at - start
                return out, table + last[at + 1 - shift :], computed
        return out, table, len(out) - start

    def piece(self, text: str) -> str:
        """The ids of one piece, decimal, joined by spaces."""
        data = text.encode()
        token = self.ranks.get(data)
        ids = str(token) if token is not None else " ".join(map(str, self.walk(self.last_tokens(data))))
        if len(self.pieces) >= CACHE_PIECES:
            self.pieces.clear()
        if len(text) <= 64:
            self.pieces[text] = ids
        return ids

    def forget(self) -> None:
        """Empty what was remembered of texts; the vocabulary stays."""
        self.pieces.clear()
        self.apart.clear()
        self.whole.clear()

    def encode_joined(self, text: str) -> str:
        """All ids of a text, decimal, joined by single spaces."""
        known, piece = self.pieces.get, self.piece
        return " ".join([known(p) or piece(p) for p in self.pattern.findall(text)])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_joined(text).split()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def spliced(self, text: str, start: int, stop: int, new: str) -> tuple[str, list[tuple[int, str]], int]:
        """Text, pieces (offset, ids) and pieces computed after ``text[start:stop]`` became ``new``.

        A piece depends on the text from its start on and one character behind it, so
        pieces that end before the edit stay, and the old ones serve again from the
        first old boundary behind it.
        """
        out, shift = text[:start] + new + text[stop:], start + len(new) - stop
        old = [m.start() for m in self.pattern.finditer(text)]
        ends = [*old[1:], len(text)]
        keep = max(0, sum(e < start for e in ends) - 1)
        pieces = [(o, self.encode_joined(text[o:e])) for o, e in zip(old[:keep], ends)]
        at, behind, computed = (old[keep] if keep < len(old) else 0), {o + shift for o in old if o >= stop}, 0
        while at < len(out):
            if at in behind and at >= start + len(new):
                pieces += [(o + shift, self.encode_joined(text[o:e])) for o, e in zip(old, ends) if o + shift >= at]
                break
            m = self.pattern.match(out, at)
            pieces.append((at, self.encode_joined(m[0])))
            computed += 1
            at = m.end()
        return out, pieces, computed


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def encoder(path: str, pattern: str) -> PrefixEncoder:
    """One per worker process; the vocabulary (some MB) is read where the tokenizer package is installed."""
    return PrefixEncoder(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ids (array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; the last is taken from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        enc.forget()
        token_bytes = {str(i): b for i, b in enc.bytes_of.items()}.__getitem__
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                joined = enc.encode_joined(t.as_py() or "")
                ids = joined.split(" ") if joined else []
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(b"".join(map(token_bytes, ids))).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=names)
        enc.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
