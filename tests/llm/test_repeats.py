"""Repeated strings against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from popspark.llm import repeats

SCHEMA = "doc_id bigint, text string"


def plain(rows, length):
    count = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        count.update(t[p : p + length] for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        runs = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(t)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def some_texts(rnd, n, letters="abcdé \n"):
    """Texts that share passages, with edits, overlaps, periods and copies."""
    text = lambda k: "".join(rnd.choice(letters) for _ in range(k))
    passages = [text(rnd.randint(15, 90)) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            p = rnd.choice(passages)
            if rnd.random() < 0.5:
                a = rnd.randrange(len(p))
                p = p[a : a + rnd.randint(1, 60)]
            if rnd.random() < 0.3:
                a = rnd.randrange(len(p))
                p = p[:a] + "#" + p[a + 1 :]
            parts += [p, text(rnd.randint(0, 30))]
        out.append("".join(parts))
    return [*out, "ab" * 40, "x" * 100, "ab" * 30 + "x" * 50, out[0], "", None, text(9), "only here " + text(60)]


def got(spark, rows, length, **more):
    df = spark.createDataFrame([(*r, 5, "s") for r in rows], SCHEMA + ", text_hash int, bytes string")
    return sorted((tuple(r) for r in repeats.digests(df, length, **more).collect()), key=str)


@pytest.mark.parametrize(("length", "batches"), [(20, 4), (16, 1), (7, 3)])
def test_equals_a_count_of_all_windows(spark, length, batches):
    rnd = random.Random(length)
    rows = list(enumerate(some_texts(rnd, 150)))
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, "a text of its own, without an id, that nobody else has")]
    rnd.shuffle(rows)
    assert got(spark, rows, length, batches=batches) == plain(rows, length)


def test_hot_grams(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    rnd = random.Random(2)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(80))
    rows = [(i, f"{rnd.random()}{passage[rnd.randint(0, 5):]}{rnd.random()}") for i in range(60)] + [(90 + i, t) for i, t in enumerate(some_texts(rnd, 30))]
    assert got(spark, rows, 20) == plain(rows, 20)


def test_length_of_the_contract(spark):
    rnd = random.Random(6)
    text = lambda n: " ".join(rnd.choice(("über", "alpha", "beta", "gamma", "x")) + str(rnd.randint(0, 99)) for _ in range(n))
    shared, long = text(60), text(20_000)
    rows = [(1, text(100) + shared + text(80)), (2, shared + text(50)), (3, long), (4, text(30) + long[1000:9000] + text(30)), (5, shared[:199]), (6, text(500)), (7, long[500:5000])]
    assert got(spark, rows, 200) == plain(rows, 200)


def test_empty_table(spark):
    assert repeats.digests(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("slab", [5, 64, 1 << 20])
def test_anchors_have_every_window_once(monkeypatch, slab):
    monkeypatch.setattr(repeats, "SLAB", slab)
    rnd, length = random.Random(slab), 20
    texts = [t.encode() for t in some_texts(rnd, 20) if t is not None]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    seen, offset = Counter(), {}
    for part in repeats.anchors_in(data, at, length):
        for row, x, lo, hi, *_ in zip(*(p.tolist() for p in part)):
            for d in range(lo, hi + 1):
                seen[row, x - d] += 1
                # Equal windows have their anchor at one offset.
                assert offset.setdefault(texts[row][x - d : x - d + length], d) == d
    assert seen == Counter((k, p) for k, t in enumerate(texts) for p in range(len(t) - length + 1))


def test_levels_merge_geometrically(spark):
    family = repeats.Family(spark)
    sizes, grams = [], [[1, 2, 3], [3, 4], [5, 5], [6], [1]]
    for batch in grams:
        family.add(spark.createDataFrame([(g,) for g in batch], "core bigint"))
        sizes.append([n for n, _, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    assert sorted(r.core for r in family.twice().collect()) == [1, 3, 5]
    family.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("suffixes_")]
