"""Hard negatives against a plain search over all rows."""

import random

import numpy as np

from popspark.llm import hardneg

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows):
    """The contract in plain Python, rows in any order."""
    own = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.array(v, dtype=np.float64))))
    dim = max((len(v) for _, _, v in own), default=0)
    own = [(i, label, np.pad(v, (0, dim - len(v)))) for i, label, v in own]
    out = []
    anchors = {(i, label, tuple(v)) for i, label, v in own if i % 50 == 0}
    for i, label, v in anchors:
        scored = sorted(((-int(np.dot(v, w)), j, other) for j, other, w in own))
        positive = [(j, -s) for s, j, other in scored if other == label and j != i][:5]
        for j, p in positive:
            fits = [(k, -s) for s, k, other in scored if other != label and 50 * p <= 100 * -s <= 95 * p][:3]
            out += [(i, j, n + 1, k, p, s) for n, (k, s) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **more):
    return sorted(tuple(r) for r in hardneg.mined(spark.createDataFrame(rows, SCHEMA)).collect())


def test_equals_plain_search(spark):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(6, 12)) / 3
    rows = [(i, [float(x) for x in (centres[i % 6] + rnd.normal(size=12) / 4).astype(np.float32)], int(i % 6 if i % 5 else rnd.integers(0, 10))) for i in range(600)]
    rows += [(700 + i, rows[3][1], i % 3) for i in range(40)]  # copies of one vector: ties by id
    rows += [(1000, None, 1), (1050, rows[0][1], None), (1100, [float("nan")] * 12, 1), (1150, [*rows[1][1][:11], None], 2), (None, rows[2][1], 1), (1200, rows[2][1][:5], 2), (1250, [], 3), (1300, [0.0] * 12, 3), (1350, [float("inf")] + [0.0] * 11, 3)]
    rows += [rows[10], rows[50]]
    random.Random(1).shuffle(rows)
    assert mined(spark, rows) == plain(rows)


def test_many_pages_batches_and_slices(spark, monkeypatch):
    for name, value in (("PAGE", 32), ("BATCH", 2), ("SLICE", 2), ("CHUNK", 7), ("PIVOTS", 5), ("SAMPLE", 60), ("FIRST_REACH", 0.01)):
        monkeypatch.setattr(hardneg, name, value)
    rnd = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rnd.normal(size=4).astype(np.float32)], int(i % 4)) for i in range(400)]
    assert mined(spark, rows) == plain(rows)


def test_empty_few_and_wide_values(spark):
    assert hardneg.mined(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mined(spark, [(1, [1.0, 2.0], 3)]) == []
    rows = [(i * 50, [float((i * 37 % 11) * 1e4), float(i)], i % 2) for i in range(8)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, [(i * 50, [1e30], i % 2) for i in range(4)]) == []
