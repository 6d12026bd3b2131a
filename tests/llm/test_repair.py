"""Conversation repair against a search of all edits, and against a plain table of the lattice."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from popspark.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if re.findall(r"[^\x20\x09-\x0D]", text)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def finished(rows, edits, roles):
    """Cost, audit and repaired rows of a choice of edits, or None where it isn't allowed."""
    cost, audit, out = 0, "", []
    marks = faults(rows)
    for i, (edit, role) in enumerate(zip(edits, roles)):
        for new in edit[0]:
            cost, audit = cost + 5, audit + "I"
            out.append((new, ""))
        if i == len(rows):
            break
        kind = edit[1]
        if kind == "D":
            cost += 2
        elif marks[i] in ("blank", "duplicate"):
            return None
        else:
            cost += (kind == "R") + 5 * (marks[i] == "truncated")
            out.append((role if kind == "R" else rows[i][0], rows[i][1]))
        audit += kind
    if not re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
        return None
    return cost, audit, out


def brute(rows):
    """Every way of at most one insert in each gap (two after the last row)."""
    gap = [(), ("user",), ("assistant",), ("user", "assistant")]
    best = None
    choices = [[((g, k), r) for g in gap for k, r in (("D", ""), ("K", ""), ("R", "user"), ("R", "assistant"))] for _ in rows] + [[((g, ""), "") for g in gap]]
    for way in itertools.product(*choices):
        got = finished(rows, [e for e, _ in way], [r for _, r in way])
        if got and (best is None or got[:2] < best[:2]):
            best = got
    return best


def table(rows):
    """The lattice filled row by row; whole audits are compared."""
    marks, start = faults(rows), {0: (0, "", ())}

    def inserted(at):
        for _ in range(3):
            for s, (c, a, o) in list(at.items()):
                letter, role = repair.NEXT[s]
                t, new = repair.MOVES[s, letter], (c + 5, a + "I", (*o, (role, "")))
                if t not in at or new[:2] < at[t][:2]:
                    at[t] = new
        return at

    at = inserted(start)
    for (role, text), mark in zip(rows, marks):
        after = {}

        def put(s, new):
            if s not in after or new[:2] < after[s][:2]:
                after[s] = new

        for s, (c, a, o) in at.items():
            put(s, (c + 2, a + "D", o))
            if mark not in ("blank", "duplicate"):
                more = 5 * (mark == "truncated")
                if (s, role[:1]) in repair.MOVES:
                    put(repair.MOVES[s, role[:1]], (c + more, a + "K", (*o, (role, text))))
                letter, wanted = repair.NEXT[s]
                put(repair.MOVES[s, letter], (c + 1 + more, a + "R", (*o, (wanted, text))))
        at = inserted(after)
    return min((at[s] for s in (0, 3) if s in at), key=lambda x: x[:2])


def digest(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def some_rows(rnd, n):
    roles, texts = ["user", "assistant", "system", "tool", "user", "assistant"], ["Hi.", "So", " \n", "Yes!", "Why? ", "No end", "a.", "b.", "c.", "d."]
    return [(rnd.choice(roles), rnd.choice(texts)) for _ in range(n)]


def test_search_equals_all_ways():
    rnd = random.Random(3)
    for _ in range(25):
        rows = some_rows(rnd, rnd.randint(0, 3))
        marks = faults(rows)
        got = repair.search({0: (0, "")}, [repair.Row(r, t, m) for (r, t), m in zip(rows, marks)], last=True)
        ((cost, audit),) = got.values()
        assert (cost, audit) == brute(rows)[:2], rows


@pytest.mark.parametrize("segment", [1, 2, 7, 512])
def test_segments_equal_the_table(segment):
    rnd = random.Random(segment)
    for _ in range(150):
        rows = some_rows(rnd, rnd.randint(0, 40))
        one, out = repair.Repair(segment), []
        seen = set()
        for role, text in rows:
            out += one.add(None, role, text, (role, text) in seen)
            seen.add((role, text))
        out += one.close()
        ((cost, _),) = one.front.values()
        want = table(rows)
        assert (cost, "".join(one.audit)) == want[:2]
        assert [(r, t) for e, r, t in out if e != "D"] == list(want[2])


def expected(rows):
    """The whole query in plain Python."""
    by, after = defaultdict(list), defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in by.items():
        for turn, role, text in own:
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if k == 1:
                text = ""
            if k == 2:
                text = re.sub("[.!?]", "", text)
            if k == 4:
                role = "user"
            after[conv] += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for conv in by:
        own = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        pairs = [r[1:] for r in own]
        marks, turns = faults(pairs), [t for t, _, _ in own if t is not None]
        cost, audit, kept = table(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, digest(kept)))
    return sorted(out, key=str)


def test_query_equals_plain(spark):
    rnd = random.Random(9)
    rows = [(c, t, *r) for c in range(120) for t, r in enumerate(some_rows(rnd, rnd.randint(1, 9)))]
    rows += [(500, t, *r) for t, r in enumerate(some_rows(rnd, 700))]
    rows += [(None, 3, "user", "No conversation."), (None, None, None, None), (7, None, "system", "Null turn."), (8, 2, None, "No role."), (9, 1, "user", None)]
    rows += [(700, 2**62 + t, "user", "Far.") for t in range(3)] + [(800, 1, "user", "x" * 300_000 + ".")] + [(900, 4, "user", "Same.")] * 3
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", edit int")
    got = sorted((tuple(r) for r in repair.conversation_repair(df).collect()), key=str)
    assert got == expected(rows)


def test_dropped_conversation_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = repair.conversation_repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.conversation_repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Bye."), (1, 3, "tool", " ")]
    got = repair.repaired_turns(repair.undamaged(spark.createDataFrame(rows, SCHEMA))).orderBy("place").collect()
    assert sorted((r.place is None, r.place, r.edit, r.role, r.text) for r in got if r.place is not None) == [(False, 0, "K", "user", "Hello."), (False, 1, "K", "assistant", "Bye.")]
    assert sorted((r.edit, r.role, r.text) for r in got if r.place is None) == [("D", None, " "), ("D", None, "Hi.")]
