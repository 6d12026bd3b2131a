"""Result tables and rarefaction against plain counts."""

import math
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest

from popspark.dataset import Dataset
from popspark.operators import tables

LOCI = ("L1", "L2", "L3", "L4")


@pytest.fixture(scope="module")
def scored():
    """ind, pop, region, locus, a1, a2 of two populations of different sizes; some cells are missing, one allele is private."""
    g = np.random.default_rng(3)
    rows = []
    for i in range(26):
        pop = "A" if i < 11 else "B"
        for k, locus in enumerate(LOCI):
            if g.random() < 0.12:
                continue
            a = g.choice(3 + (pop == "B" and k == 0), 2)
            rows.append((i, pop, "R", locus, int(a[0]), int(a[1])))
    return rows


@pytest.fixture(scope="module")
def data(spark, scored):
    return Dataset(spark, geno=spark.createDataFrame(scored, "ind bigint, pop string, region string, locus string, a1 bigint, a2 bigint"))


def copies(rows, pop=None):
    out = {}
    for _, p, _, locus, a, b in rows:
        if pop in (None, p):
            out.setdefault(locus, Counter()).update([a, b])
    return out


def least(rows):
    return min(sum(c.values()) for p in "AB" for c in copies(rows, p).values())


def richness(c, g):
    n = sum(c.values())
    return sum(1 - math.comb(n - k, g) / math.comb(n, g) for k in c.values())


def test_rarefaction_equals_binomials(data, scored):
    g = least(scored)
    got = {(r.pop, r.locus): r.ar for r in data.result("rarefied_richness").collect()}
    assert got == pytest.approx({(p, x): richness(c, g) for p in "AB" for x, c in copies(scored, p).items()}, abs=1e-6)
    curve = {(r.pop, r.g): r.ar for r in data.result("rarefaction_curve").collect()}
    sizes = {g for _, g in curve}
    assert max(sizes) <= g and min(sizes) == 2
    assert curve == pytest.approx({(p, s): np.mean([richness(c, s) for c in copies(scored, p).values()]) for p in "AB" for s in sizes}, abs=1e-6)


def test_summary_table(data, scored):
    got = {r.population: r for r in data.result("summary_table").collect()}
    assert set(got) == {"A", "B", "Pooled"}
    whole = copies(scored)
    for pop, name in (("A", "A"), ("B", "B"), (None, "Pooled")):
        cells = copies(scored, pop)
        other = {"A": copies(scored, "B"), "B": copies(scored, "A")}.get(pop)
        he = [1 - sum((k / sum(c.values())) ** 2 for k in c.values()) for c in cells.values()]
        ho = [np.mean([a != b for _, p, _, x, a, b in scored if x == locus and pop in (None, p)]) for locus in cells]
        r = got[name]
        assert r.n == len({i for i, p, *_ in scored if pop in (None, p)})
        assert r.total_alleles == sum(len(c) for c in cells.values()) and r.n_poly == sum(len(c) > 1 for c in cells.values())
        private = {p: sum(a not in copies(scored, q)[x] for x, c in copies(scored, p).items() for a in c) for p, q in ("AB", "BA")}
        assert r.private_alleles == (private[pop] if pop else sum(private.values()))
        assert other is None or r.private_alleles == sum(a not in other[x] for x in cells for a in cells[x])
        assert (r.na, r.he, r.ho) == pytest.approx((np.mean([len(c) for c in cells.values()]), np.mean(he), np.mean(ho)), abs=1e-6)
        assert (r.he_se, r.ho_se) == pytest.approx((np.std(he, ddof=1) / 2, np.std(ho, ddof=1) / 2), abs=1e-6)
        assert r.f == pytest.approx(np.mean([1 - o / e for o, e in zip(ho, he)]), abs=1e-6)
    assert got["Pooled"].ar is None and got["A"].ar == pytest.approx(np.mean([richness(c, least(scored)) for c in copies(scored, "A").values()]), abs=1e-6)
    assert whole.keys() == set(LOCI)


def drift(comps):
    w = [k for _, _, _, k, _ in comps]
    r2 = sum(r * k for _, _, r, k, _ in comps) / sum(w)
    s = sum(w) / sum(k / n for _, _, _, k, n in comps)
    return r2, r2 - (1 / s + 3.19 / s**2 if s >= 30 else 0.0018 + 0.907 / s + 4.44 / s**2), s


def size(x, s):
    if x <= 0:
        return None
    return (1 / 3 + math.sqrt(max(0, 1 / 9 - 2.76 * x))) / (2 * x) if s >= 30 else (0.308 + math.sqrt(max(0, 0.308**2 - 2.08 * x))) / (2 * x)


def test_effective_size_with_limits(data, scored):
    got = {r.pop: r for r in data.result("effective_size_table").collect()}
    for pop in "AB":
        of = {(i, x): (a, b) for i, p, _, x, a, b in scored if p == pop}
        freq = {x: {a: k / sum(c.values()) for a, k in c.items()} for x, c in copies(scored, pop).items()}
        comps = []
        for x, y in combinations(LOCI, 2):
            inds = [i for i in range(26) if (i, x) in of and (i, y) in of]
            found, n = [], len(inds)
            for a, b in product(freq[x], freq[y]):
                if not (0.02 <= freq[x][a] <= 0.98 and 0.02 <= freq[y][b] <= 0.98):
                    continue
                da, db = (np.array([of[i, z].count(c) for i in inds], float) for z, c in ((x, a), (y, b)))
                pa, pb = da.mean() / 2, db.mean() / 2
                delta = n / (n - 1) * ((da * db).sum() / (2 * n) - 2 * pa * pb)
                den = (pa * (1 - pa) + (da == 2).mean() - pa**2) * (pb * (1 - pb) + (db == 2).mean() - pb**2)
                if den > 0:
                    found.append(delta**2 / den)
            comps.append((x, y, np.mean(found), len(found), n))
        r2, x, s = drift(comps)
        left = [drift([c for c in comps if locus not in c[:2]])[1] for locus in LOCI]
        se = math.sqrt(3 / 4 * sum((v - np.mean(left)) ** 2 for v in left))
        r = got[pop]
        assert (r.n, r.locus_pairs) == (len({i for i, p, *_ in scored if p == pop}), 6)
        assert (r.mean_r2, r.expected_r2) == pytest.approx((r2, r2 - x), abs=1e-6)
        for value, want in ((r.ne_ld, size(x, s)), (r.ne_ld_lower, size(x + 1.96 * se, s)), (r.ne_ld_upper, size(x - 1.96 * se, s))):
            assert value == (None if want is None else pytest.approx(want, abs=1e-4))


def test_fstatistics_table_ends_with_all_loci(data):
    rows = {r.locus: r for r in data.result("fstatistics_table").collect()}
    assert set(rows) == {*LOCI, "Multilocus"}
    parts = {r.locus: r for r in data.result("theta_by_locus").collect()}
    assert rows["L2"].theta == parts["L2"].theta and rows["L2"].fit == parts["L2"].fit
    total = sum(p.a + p.b + p.c for p in parts.values())
    assert rows["Multilocus"].theta == pytest.approx(sum(p.a for p in parts.values()) / total, abs=1e-5)
    assert rows["Multilocus"].hs == pytest.approx(np.mean([rows[x].hs for x in LOCI]), abs=1e-6)


def test_selfing_table(data):
    for r in data.result("selfing_table").collect():
        assert r.loci == 4 and r.f_low <= r.f_high
        for f, s in ((r.f_is, r.selfing_rate), (r.f_low, r.selfing_low), (r.f_high, r.selfing_high)):
            assert s == pytest.approx(max(0, 2 * f / (1 + f)), abs=1e-5)


def test_data_as_analysed(spark):
    geno = spark.createDataFrame([(1, "A", "R", "my.x", 3, 4), (1, "A", "R", "y", 1, 1), (2, None, None, "y", 5, 6)], "ind int, pop string, region string, locus string, a1 int, a2 int")
    places = spark.createDataFrame([(1, "A", 1.5, 2.5), (9, "Z", 0.0, 0.0)], "ind int, pop string, lat double, lon double")
    got = tables.data_as_analysed(geno, places)
    assert got.columns == ["individual", "population", "region", "latitude", "longitude", "my.x_1", "my.x_2", "y_1", "y_2"]
    assert sorted(map(tuple, got.collect())) == [(1, "A", "R", 1.5, 2.5, 3, 4, 1, 1), (2, None, None, None, None, None, None, 5, 6)]
    assert tables.data_as_analysed(geno.limit(0), places).count() == 0


def test_distance_matrix(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.25)], "p1 string, p2 string, d double")
    got = tables.distance_matrix(pairs, "d").orderBy("name")
    assert got.columns == ["name", "a", "b", "c"]
    assert list(map(tuple, got.collect())) == [("a", 0.0, 0.5, 0.25), ("b", 0.5, 0.0, None), ("c", 0.25, None, 0.0)]


def test_tables_of_tests(spark):
    family = spark.createDataFrame([("A", "L", 9, 3, 0.1234567, 0.2, 0.4, None)], "pop string, locus string, n int, k int, fis double, p double, p_holm double, null_frequency double")
    exact = spark.createDataFrame([("A", "L", 0.01)], "pop string, locus string, p_deficit double")
    cells = spark.createDataFrame([("A", "L", 0.5), ("B", "L", 0.5)], "pop string, locus string, ho double")
    assert list(map(tuple, tables.hwe_table(family, exact, cells).collect())) == [("A", "L", 9, 3, 0.5, 0.12346, 0.2, 0.4, 0.01, None)]
    tests = spark.createDataFrame([("A", "B", 0.1, 0.04, 0.2, 0.06)], "p1 string, p2 string, theta double, p_theta_holm double, phi double, p_phi_holm double")
    nei = spark.createDataFrame([("A", "B", 0.3, 0.4, 0.5), ("A", "C", 0.6, 0.7, 0.8)], "p1 string, p2 string, gst double, gst_hedrick double, jost_d double")
    theta = spark.createDataFrame([("A", "B", 2.5)], "p1 string, p2 string, nm double")
    got = tables.differentiation_table(tests, nei, theta).orderBy("p2").collect()
    assert list(map(tuple, got)) == [("A", "B", 0.1, 0.04, 0.2, 0.06, 0.3, 0.4, 0.5, 2.5), ("A", "C", None, None, None, None, 0.6, 0.7, 0.8, None)]
