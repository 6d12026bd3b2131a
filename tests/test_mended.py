"""Cases that earlier versions got wrong, and the family of tests."""

import math

import numpy as np
import pytest

from popspark.dataset import Dataset
from popspark.operators import family, haplotypes, patterns
from popspark.plans.compose import STEPS

GENO = "ind bigint, pop string, region string, locus string, a1 {0}, a2 {0}"


def test_m_ratio_of_text_alleles(spark):
    rows = [(i, "A", "R", "L1", a, b) for i, (a, b) in enumerate([("180", "184"), ("184", "190"), ("x", "180"), ("180", "180")])]
    rows += [(i, "A", "R", "L2", "wild", "crop") for i in range(4)]
    got = Dataset(spark, geno=spark.createDataFrame(rows, GENO.format("string"))).result("m_ratio").collect()
    assert [(r.locus, r.k, r.m) for r in got] == [("L1", 3, pytest.approx(3 / 11, abs=1e-6))]


def test_correlation_of_any_traits(spark):
    g = np.random.default_rng(1)
    v = {t: g.normal(size=12).round(1) for t in ("leaf", "ear", "stem")}
    data = Dataset(spark, traits=spark.createDataFrame([(i, "P", t, float(v[t][i])) for t in v for i in range(12)], "ind bigint, pop string, trait string, v double"))
    got = {(r.t1, r.t2): r.pearson for r in data.result("trait_correlation").collect()}
    assert got == pytest.approx({(a, b): np.corrcoef(v[a], v[b])[0, 1] for a, b in (("ear", "leaf"), ("ear", "stem"), ("leaf", "stem"))}, abs=1e-6)


def k2p(a, b):
    pairs = [x + y for x, y in zip(a, b) if x in "ACGT" and y in "ACGT"]
    if not pairs:
        return 0, None, 0.0
    p = sum(x in ("AG", "GA", "CT", "TC") for x in pairs) / len(pairs)
    q = sum(x[0] != x[1] for x in pairs) / len(pairs) - p
    u, v = 1 - 2 * p - q, 1 - 2 * q
    return len(pairs), p + q, -0.5 * math.log(u) - 0.25 * math.log(v) if u > 0 and v > 0 else 3.0


def gapped(spark, n=9, length=40):
    g = np.random.default_rng(7)
    base = g.choice(list("ACGT"), length)
    seqs = {}
    for i in range(n):
        own = base.copy()
        for k in g.choice(length, 6, replace=False):
            own[k] = g.choice(list("ACGT-N"))
        seqs[10 + i] = "".join(own)
    seqs[99], seqs[50] = "-" * length, seqs[11]
    rows = [(i, "PQR"[i % 3], k + 1, b) for i, s in seqs.items() for k, b in enumerate(s)]
    return seqs, spark.createDataFrame(rows, "ind bigint, pop string, site int, base string")


@pytest.mark.parametrize(("block", "every"), [(512, 1), (3, 1), (4, 5)])
def test_distances_of_sequences_with_gaps(spark, monkeypatch, block, every):
    monkeypatch.setattr(patterns, "BLOCK", block)
    seqs, sites = gapped(spark)
    data = Dataset(spark, sites=sites)
    want = {(i, j): k2p(seqs[i], seqs[j]) for i in seqs for j in seqs if i % every == 0 and i != j and (i < j or j % every)}
    got = {(r.i, r.j): (r.compared, r.p, r.k2p) for r in patterns.sequence_distances(sites, data.result("site_patterns"), every).collect()}
    assert set(got) == set(want)
    for k, (n, p, d) in want.items():
        assert got[k][0] == n and got[k][2] == pytest.approx(d, abs=1e-9) and (got[k][1] is None if p is None else got[k][1] == pytest.approx(p, abs=1e-9))
    if every == 1 and block == 512:
        assert {(r.i, r.j): r.k2p for r in data.result("k2p_distance").collect()} == pytest.approx({k: v[2] for k, v in want.items()}, abs=1e-5)


def test_site_patterns(spark):
    seqs, sites = gapped(spark)
    columns = {}
    for k in range(40):
        columns.setdefault(tuple(s[k] if s[k] in "ACGT" else "-" for s in seqs.values()), []).append(k + 1)
    got = {r.site: (r.weight, r.kinds, r.gaps) for r in Dataset(spark, sites=sites).result("site_patterns").collect()}
    assert got == {v[0]: (len(v), len(set(c)), c.count("-")) for c, v in columns.items()}


def test_weights_of_chunks_add_up():
    w, sizes = [np.array([1, 2]), np.array([4]), np.array([3, 0, 2])], np.array([3, 4, 5])
    drawn = np.hstack([patterns.weights(own, sizes, c, 5000, 12, "t") for c, own in enumerate(w)])
    assert (drawn.sum(axis=1) == 12).all()
    assert drawn.mean(axis=0) == pytest.approx(np.concatenate(w), abs=0.15)
    assert drawn.var(axis=0)[2] == pytest.approx(12 * 1 / 3 * 2 / 3, rel=0.1)


def test_dxy_bootstrap(spark, monkeypatch):
    monkeypatch.setattr(patterns, "PATTERNS", 5)
    g = np.random.default_rng(3)
    seqs = {i: "".join(g.choice(list("ACGT"), 30, p=[0.7, 0.1, 0.1, 0.1])) for i in range(12)}
    sites = spark.createDataFrame([(i, "PQ"[i % 2], k, b) for i, s in seqs.items() for k, b in enumerate(s)], "ind bigint, pop string, site int, base string")
    data = Dataset(spark, sites=sites)
    (got,) = patterns.bootstrap_dxy(sites, data.result("site_patterns"), 400).collect()
    want = data.result("dxy_da").first()
    assert (got.dxy, got.da) == pytest.approx((want.dxy, want.da), abs=1e-6)
    per_site = [np.mean([seqs[i][k] != seqs[j][k] for i in range(0, 12, 2) for j in range(1, 12, 2)]) for k in range(30)]
    draws = [np.mean(g.choice(per_site, 30)) for _ in range(4000)]
    assert (got.dxy_low, got.dxy_high) == pytest.approx(np.quantile(draws, (0.025, 0.975)), abs=0.02)


def em(pairs):
    f = [0.25] * 4
    for _ in range(200):
        c = [0.0] * 4
        for x, y in pairs:
            if x == 1 and y == 1:
                u, v = f[0] * f[3], f[1] * f[2]
                t = u + v or 1
                for k, w in ((0, u), (3, u), (1, v), (2, v)):
                    c[k] += w / t
            else:
                a, b = [0] * x + [1] * (2 - x), [0] * y + [1] * (2 - y)
                for k in range(2):
                    c[2 * a[k] + b[k]] += 1
        new = [v / (2 * len(pairs)) for v in c]
        done = sum(abs(p - q) for p, q in zip(new, f)) < 1e-9
        f = new
        if done:
            break
    return f


def test_haplotypes_by_em(spark):
    g = np.random.default_rng(5)
    rows, doses = [], {}
    for i in range(60):
        pop = "AB"[i % 2]
        haps = [(0, 0), (1, 1), (0, 1)]
        pair = [haps[k] for k in g.choice(3, 2, p=[0.5, 0.35, 0.15])]
        for l in (0, 1, 2):
            if g.random() < 0.9:
                alleles = [h[l] if l < 2 else int(g.integers(0, 3)) for h in pair]
                rows.append((i, pop, "R", f"L{l}", *alleles))
                doses[pop, i, l] = alleles.count(0)
    got = {(r.pop, r.l1, r.l2): r for r in Dataset(spark, geno=spark.createDataFrame(rows, GENO.format("bigint"))).result("haplotype_em").collect()}
    assert len(got) == 6 and haplotypes.ROUNDS == 200 and "certain" in STEPS
    for (pop, a, b), r in got.items():
        pairs = [(doses[pop, i, int(a[1])], doses[pop, i, int(b[1])]) for i in range(60) if (pop, i, int(a[1])) in doses and (pop, i, int(b[1])) in doses]
        f = em(pairs)
        assert (r.n, r.f_ab, r.f_a, r.f_b, r.f_none) == pytest.approx((len(pairs), *f), abs=2e-6)
        d = f[0] - (f[0] + f[1]) * (f[0] + f[2])
        assert r.r2 == pytest.approx(d * d / ((f[0] + f[1]) * (f[2] + f[3]) * (f[0] + f[2]) * (f[1] + f[3])), abs=1e-5)


def test_family_of_tests(spark):
    cells = [("A", "L1", 0.001, 0.4, 0.2), ("B", "L1", 0.004, 0.3, 0.1), ("A", "L2", 0.2, 0.1, 0.01), ("B", "L2", None, None, None), ("A", "L3", 0.01, -0.2, 0.0), ("B", "L3", 0.01, -0.1, 0.0)]
    exact = spark.createDataFrame([(p, l, 10, v) for p, l, v, _, _ in cells], "pop string, locus string, n bigint, p double")
    fis = spark.createDataFrame([(p, l, f) for p, l, _, f, _ in cells], "pop string, locus string, f double")
    nulls = spark.createDataFrame([(p, l, r) for p, l, _, _, r in cells], "pop string, locus string, r double")
    kinds = spark.createDataFrame([(p, l, 3) for p, l, *_ in cells], "pop string, locus string, k int")
    whole = family.hwe_family(exact, fis, nulls, kinds)
    got = {(r.pop, r.locus): r.p_holm for r in whole.collect()}
    assert got == pytest.approx({("A", "L1"): 0.005, ("B", "L1"): 0.016, ("A", "L3"): 0.03, ("B", "L3"): 0.03, ("A", "L2"): 0.2, ("B", "L2"): None})
    loci = {r.locus: r for r in family.by_locus(whole).collect()}
    assert [loci[l].suspect_null for l in ("L1", "L2", "L3")] == [True, False, False]
    assert (loci["L1"].n_deficit, loci["L3"].n_excess, loci["L2"].n_tested, loci["L1"].max_null) == (2, 2, 1, 0.2)
    x = -2 * (math.log(0.001) + math.log(0.004))
    assert loci["L1"].fisher_p == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-9)
    pops = {r["pop"]: r for r in family.by_population(whole).collect()}
    assert (pops["A"].n_significant, pops["A"].n_deficit, pops["B"].n_tested) == (2, 1, 2)
    geno = spark.createDataFrame([(1, "A", "R", l, 1, 2) for l in ("L1", "L2")], GENO.format("bigint"))
    assert [r.locus for r in family.without_loci(geno, family.by_locus(whole).where("suspect_null")).collect()] == ["L2"]
