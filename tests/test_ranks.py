"""Rank tests, shortest intervals, quantile functions and partitions against plain counts."""

import itertools
import math

import numpy as np
import pytest

from popspark.dataset import Dataset
from popspark.functions import special
from popspark.operators import ranks


def plain(diffs):
    d = [v for v in diffs if v]
    r = [sum(abs(w) < abs(v) for w in d) + (sum(abs(w) == abs(v) for w in d) + 1) / 2 for v in d]
    w = sum(k for k, v in zip(r, d) if v > 0)
    sums = [sum(k for k, s in zip(r, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    up, down = np.mean([s >= w for s in sums]), np.mean([s <= w for s in sums])
    return len(d), w, up, down, min(1, 2 * min(up, down))


def test_signed_rank(spark):
    g = np.random.default_rng(1)
    sets = {k: g.integers(-4, 6, n).tolist() for k, n in (("a", 6), ("b", 12), ("c", 15), ("d", 3))} | {"z": [0, 0, 0]}
    sets["large"] = g.normal(0.4, 1, 60).tolist()
    rows = [(k, float(v)) for k, vs in sets.items() for v in vs] + [("a", None)]
    got = {r.key: r for r in ranks.signed_rank(spark.createDataFrame(rows, "key string, v double")).collect()}
    assert "z" not in got
    for k in "abc":
        assert tuple(got[k])[1:] == pytest.approx(plain(sets[k]), abs=1e-12)
    assert got["d"].p_excess is None
    n, w = 60, got["large"].w
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert got["large"].p_excess == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=1e-12)


def test_shortest_intervals(spark):
    g = np.random.default_rng(2)
    sets = {"skew": g.exponential(1, 2000), "ties": g.integers(0, 5, 700).astype(float), "one": np.array([3.0]), "two": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in sets.items() for v in vs] + [("two", None)]
    got = {r.key: (r.n, r.low, r.high) for r in ranks.hpd(spark.createDataFrame(rows, "key string, v double")).collect()}
    for k, vs in sets.items():
        s = np.sort(vs)
        m = max(1, math.floor(0.95 * len(s)))
        i = int(np.argmin(s[m - 1 :] - s[: len(s) - m + 1]))
        assert got[k] == (len(s), s[i], s[i + m - 1])


def test_vectorised_functions_equal_the_plain_ones():
    g = np.random.default_rng(3)
    a, x = g.uniform(0.2, 60, 300), g.uniform(0, 120, 300)
    assert special.gamma_tails(a, x) == pytest.approx([special.gamma_tail(*v) for v in zip(a, x)], abs=1e-12)
    b, y = g.uniform(0.2, 40, 300), g.uniform(0, 1, 300)
    assert special.beta_parts(a, b, y) == pytest.approx([special.beta_part(*v) for v in zip(a, b, y)], abs=1e-11)
    assert special.beta_parts(2.0, 3.0, np.array([0.0, 1.0])).tolist() == [0.0, 1.0]


def test_quantiles(spark):
    rows = [(0.975, 10.0, 3.0), (0.05, 1.0, 8.0), (0.5, 4.0, 4.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "p double, m double, n double")
    got = [tuple(r) for r in df.select(special.qnorm("p"), special.qt("p", "m"), special.qchisq("p", "m"), special.qf("p", "m", "n"), special.qbeta("p", "m", "n")).collect()]
    # Published tables.
    assert got[0][:3] == pytest.approx((1.959963984540054, 2.2281388519649385, 20.483177350807388), rel=1e-9)
    assert got[1][:3] == pytest.approx((-1.6448536269514722, -6.313751514675041, 0.003932140000019522), rel=1e-9)
    assert got[2] == pytest.approx((0.0, 0.0, 3.3566939800333233, 1.0, 0.5), abs=1e-9)
    assert got[3] == (None,) * 5
    for p, m, n in rows[:3]:
        f, b = got[rows.index((p, m, n))][3:]
        assert special.beta_part(m / 2, n / 2, m * f / (m * f + n)) == pytest.approx(p, abs=1e-12)
        assert special.beta_part(m, n, b) == pytest.approx(p, abs=1e-12)


def test_partitions_equal_pairs(spark):
    g = np.random.default_rng(4)
    a, b = g.integers(0, 4, 60), g.integers(0, 3, 60)
    hap = spark.createDataFrame([(i, f"P{a[i]}", "L", f"s{b[i]}") for i in range(60)] + [(99, "P0", "M", "x")], "ind bigint, pop string, locus string, allele string")
    (r,) = Dataset(spark, hap=hap).result("partition_agreement").collect()
    pairs = list(itertools.combinations(range(60), 2))
    x, y = np.array([a[i] == a[j] for i, j in pairs]), np.array([b[i] == b[j] for i, j in pairs])
    both, n = (x & y).sum(), len(pairs)
    expected = x.sum() * y.sum() / n
    assert (r.n, r.rand_adjusted, r.fowlkes_mallows) == pytest.approx((60, (both - expected) / ((x.sum() + y.sum()) / 2 - expected), both / math.sqrt(x.sum() * y.sum())), abs=1e-6)


def test_density_and_bins(spark):
    g = np.random.default_rng(6)
    v = g.gamma(2, 3, 80)
    data = Dataset(spark, traits=spark.createDataFrame([(i, "P", "ear", float(x)) for i, x in enumerate(v)], "ind bigint, pop string, trait string, v double"))
    q1, q3 = np.quantile(v, (0.25, 0.75))
    h = 0.9 * min(v.std(ddof=1), (q3 - q1) / 1.34) * 80**-0.2
    for r in data.result("trait_density").collect():
        x = v.min() + (v.max() - v.min()) * r.point / 63
        assert (r.x, r.density) == pytest.approx((x, np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (80 * h * math.sqrt(2 * math.pi))), abs=2e-6)
    (b,) = data.result("trait_bins").collect()
    assert (b.n, b.sturges, b.root, b.freedman_diaconis) == (80, 8, 9, math.ceil((v.max() - v.min()) / (2 * (q3 - q1) / 80 ** (1 / 3))))


def test_amova_design(spark):
    rows = [(10 * p + i, f"P{p}", "RRSST"[p], "L", 1, 2) for p in range(5) for i in range(2 + p)] + [(999, "Z", "S", "L", 1, 1)]
    (d,) = Dataset(spark, geno=spark.createDataFrame(rows, "ind bigint, pop string, region string, locus string, a1 bigint, a2 bigint")).result("amova_design").collect()
    # Five populations in regions of 2, 2 and 1: 5! / (2! 2! 1!) / 2!.
    assert (d.n_inds, d.n_pops, d.n_regions, d.df_regions, d.df_pops, d.df_individuals, d.df_total, d.arrangements) == (20, 5, 3, 2, 2, 15, 39, 15.0)
