"""Conversation structure repair: the cheapest edits that make the roles of a conversation well formed.

Roles, by their first letters, must read ``(s?(ua)+)?``. The edits are a path through a
lattice whose nodes are (rows read, state of that grammar); it is never built. Dijkstra's
search takes nodes by (cost, audit), the audit being the first letters of the edits, and
stops at the first accepting end node that it takes.

Rows reach a task sorted by conversation and turn and are read as a stream. A conversation
of more than ``SEGMENT`` rows is searched segment by segment; edits on which all ways agree
are decided, and their rows leave memory. So no conversation is held whole, however long:
its digest needs one task, which reads it in order.

Two ways to one node at one cost never have audits of which one begins the other (the rest
would be inserts, which cost), so the order of audits stays when both are continued.

Nulls: role and text count as one space. Rows of a null conv_id are one conversation. A null
turn sorts first and takes no part in gaps. Rows of one turn are taken by role, then text;
rows that repeat are duplicates. No rows: no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one search spans.
SEGMENT = 512
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: The grammar: state and first letter to state. 0 start, 1 after s, 2 after u, 3 after a.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
#: What each state lacks next: a letter and its role.
NEXT = {0: ("u", "user"), 1: ("u", "user"), 2: ("a", "assistant"), 3: ("u", "user")}
ORDERLY = {"su", "ua", "au"}

TURNS = "place long, edit string, role string, text string"
REPAIR = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Row(NamedTuple):
    role: str
    text: str
    fault: str  # '', 'blank', 'duplicate' or 'truncated'


def _space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged as crc32 of ``conv_id:turn`` says; a dropped row stays as a mark without text."""
    kind = F.crc32(F.concat(_space("conv_id"), F.lit(":"), _space("turn")).cast("binary")) % 20
    text = F.when(kind == 0, "").when(kind == 1, "").when(kind == 2, F.translate(_space("text"), ".!?", "")).otherwise(_space("text"))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(_space("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns of rows as they are."""
    return conversations.select("conv_id", "turn", _space("role").alias("role"), _space("text").alias("text"), F.lit(False).alias("gone"))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``again`` (role and text seen earlier in the conversation), clustered and sorted for the search.

    One shuffle by conv_id serves both orders; both sorts spill, and nothing is grouped.
    """
    by_turn = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    return rows.repartition("conv_id").withColumn("again", F.row_number().over(seen) > 1).sortWithinPartitions(F.asc_nulls_first("conv_id"), *by_turn)


def search(start: dict[int, tuple[int, str]], rows: list[Row], last: bool) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) of each state behind ``rows``, from those in ``start``; of the first accepting end only, if these are the last rows."""
    heap = [(cost, audit, 0, state) for state, (cost, audit) in start.items()]
    heapq.heapify(heap)
    taken, ends, n = set(), {}, len(rows)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in taken:
            continue
        taken.add((i, state))
        if i == n:
            if last and state in ACCEPTING:
                return {state: (cost, audit)}
            ends[state] = (cost, audit)
            if len(ends) == 4 and not last:
                break
        letter, _ = NEXT[state]
        after = MOVES[state, letter]
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, after))
        if i == n:
            continue
        row = rows[i]
        heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
        if row.fault not in ("blank", "duplicate"):
            more = TRUNCATED if row.fault == "truncated" else 0
            kept = MOVES.get((state, row.role[:1]))
            if kept is not None:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, kept))
            heapq.heappush(heap, (cost + REROLE + more, audit + "R", i + 1, after))
    return ends


class Repair:
    """The search through one conversation, row by row."""

    def __init__(self, segment: int):
        self.segment = segment
        self.front: dict[int, tuple[int, str]] = {0: (0, "")}
        self.waiting: list[Row] = []  # not searched yet
        self.open: list[Row] = []  # searched, their edits not decided
        self.state, self.audit, self.place = 0, [], 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.initial = 0, None
        self.low = self.high = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, again: bool) -> Iterator[tuple[str, str, str]]:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        end = text.rstrip(SPACE)
        fault = "blank" if not end else "duplicate" if again else "" if end[-1] in ".!?" else "truncated"
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ORDERLY:
            self.illegal += 1
        self.initial = role[:1]
        self.waiting.append(Row(role, text, fault))
        if len(self.waiting) > self.segment:
            yield from self._searched(self.waiting[: self.segment], last=False)
            del self.waiting[: self.segment]

    def close(self) -> Iterator[tuple[str, str, str]]:
        yield from self._searched(self.waiting, last=True)
        self.waiting = []

    def _searched(self, rows: list[Row], last: bool) -> Iterator[tuple[str, str, str]]:
        self.front = search(self.front, rows, last)
        self.open += rows
        agreed = os.path.commonprefix([a for _, a in self.front.values()])
        yield from self._decided(agreed)
        self.front = {s: (c, a[len(agreed) :]) for s, (c, a) in self.front.items()}

    def _decided(self, edits: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of each edit; a deleted row has no role."""
        self.audit.append(edits)
        used = 0
        for edit in edits:
            letter, wanted = NEXT[self.state]
            if edit == "I":
                yield edit, wanted, ""
                self.state = MOVES[self.state, letter]
                continue
            row = self.open[used]
            used += 1
            if edit == "D":
                yield edit, "", row.text
                continue
            role = row.role if edit == "K" else wanted
            yield edit, role, row.text
            self.state = MOVES[self.state, row.role[:1] if edit == "K" else letter]
        del self.open[:used]

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """conv_id and the rows of each conversation in turn, from sorted batches. Read each one's rows to their end."""
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for key, group in groupby(rows(), key=lambda r: r[0]):
        yield key, ((turn, role, text, again) for _, turn, role, text, gone, again in group if not gone)


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    part = []
    for r in rows:
        part.append(r)
        if len(part) >= size:
            yield pa.RecordBatch.from_pylist(part, schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def _over(rows: DataFrame, made: Callable[[object, Iterator[tuple]], Iterator[dict]], columns: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    clustered = ordered(rows).select("conv_id", "turn", "role", "text", "gone", "again")
    kind = clustered.schema["conv_id"].dataType.simpleString()
    empty = clustered.sparkSession.createDataFrame([], f"conv_id {kind}, {columns}")
    schema = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((r for key, group in _conversations(batches) for r in made(key, group)), schema)

    return clustered.mapInArrow(run, empty.schema)


def repaired_turns(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, place (from 0), edit (K, R, I or D), role, text: every conversation after repair; deleted rows have a null place and role."""

    def made(key: object, group: Iterator[tuple]) -> Iterator[dict]:
        repair, place = Repair(segment), 0

        def turns() -> Iterator[tuple[str, str, str]]:
            for r in group:
                yield from repair.add(*r)
            yield from repair.close()

        for edit, role, text in turns():
            stays = edit != "D"
            yield {"conv_id": key, "place": place if stays else None, "edit": edit, "role": role if stays else None, "text": text}
            place += stays

    return _over(rows, made, TURNS)


def repairs(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row per conversation: faults, cost and audit of the repair, digest of the repaired ``role:text`` lines."""

    def made(key: object, group: Iterator[tuple]) -> Iterator[dict]:
        repair, digest, first, cost = Repair(segment), hashlib.sha256(), True, 0

        def take(edits: Iterator[tuple[str, str, str]]) -> None:
            nonlocal first
            for edit, role, text in edits:
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                    first = False

        for r in group:
            take(repair.add(*r))
        take(repair.close())
        ((cost, _),) = repair.front.values()
        yield {"conv_id": key, "gaps": repair.gaps(), **repair.counts, "illegal": repair.illegal, "cost": cost, "audit": "".join(repair.audit), "repaired_sha256": digest.hexdigest()}

    return _over(rows, made, REPAIR)


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """Damage by crc32, then repair; every conv_id of the table has a row."""
    return repairs(damaged(conversations))
