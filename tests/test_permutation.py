"""Permutation tests against all arrangements of small data sets, and sums over pairs of individuals."""

import itertools
from collections import Counter

import numpy as np
import pytest

from popspark.dataset import Dataset
from popspark.operators import association, permutation

GENO = "ind bigint, pop string, region string, locus string, a1 bigint, a2 bigint"


def test_dealt_chunks_keep_totals_and_are_uniform():
    totals, sizes = np.array([5, 0, 9, 2]), np.array([3, 6, 0, 7])
    parts = [permutation.dealt(totals, sizes, c, 4000, "x") for c in range(4)]
    assert (sum(parts) == totals).all()
    assert all((p.sum(axis=1) == n).all() for p, n in zip(parts, sizes))
    for p, n in zip(parts, sizes):
        assert p.mean(axis=0) == pytest.approx(totals * n / 16, abs=0.1)
    labels = list(permutation.shuffled(totals, sizes, 1, 50, "x"))
    assert [Counter(v.tolist()) for v in labels] == [Counter({j: int(c) for j, c in enumerate(p) if c}) for p in permutation.dealt(totals, sizes, 1, 50, "x")]


def test_pairings_are_random_matchings():
    counts, g = np.array([3, 2, 1]), np.random.default_rng(1)
    drawn = list(permutation.pairings(counts, 30_000, g))
    got = Counter(tuple(int(d[r, i]) for i, d in enumerate(drawn)) for r in range(30_000))
    want, copies = Counter(), [0, 0, 0, 1, 1, 2]
    for p in itertools.permutations(range(6)):
        same = Counter(copies[p[k]] for k in (0, 2, 4) if copies[p[k]] == copies[p[k + 1]])
        want[tuple(same[i] for i in range(3))] += 1
    total = sum(want.values())
    assert {k: v / 30_000 for k, v in got.items()} == pytest.approx({k: v / total for k, v in want.items()}, abs=0.015)


def test_log_factorial():
    x = np.array([0, 1, 5, 255, 256, 1000, 10**6])
    want = [sum(np.log(np.arange(1, n + 1))) for n in x]
    assert permutation.log_factorial(x) == pytest.approx(want, rel=1e-12)


def small(seed, pops, per, loci=2):
    """Populations named A, B, ..., two to a region, with some missing genotypes."""
    g = np.random.default_rng(seed)
    rows = []
    for i in range(pops * per):
        p = i // per
        for l in range(loci):
            if g.random() > 0.1:
                rows.append((100 + i, "ABCDEF"[p], "RS"[p % 2], f"L{l}", *(int(x) for x in np.clip(g.integers(0, 3, 2) + (p == 0), 0, 2))))
    return rows


def counted(rows, pop_of):
    """Alleles of the rows with individuals' populations given by ``pop_of``."""
    kinds = sorted({(r[3], a) for r in rows for a in r[4:]})
    loci = sorted({k[0] for k in kinds})
    pops = sorted(set(pop_of.values()))
    n, het = np.zeros((len(pops), len(kinds)), int), np.zeros((len(pops), len(kinds)), int)
    for i, _, _, l, a, b in rows:
        for x in (a, b):
            n[pops.index(pop_of[i]), kinds.index((l, x))] += 1
            het[pops.index(pop_of[i]), kinds.index((l, x))] += a != b
    return permutation.Alleles(n, het, np.array([loci.index(k[0]) for k in kinds]))


def phi(parts, over, of):
    return sum(parts[i] for i in over) / sum(parts[i] for i in of)


def arrangements(labels):
    return set(itertools.permutations(labels))


@pytest.mark.parametrize("chunk", [8192, 3])
def test_amova_tests_equal_all_arrangements(spark, monkeypatch, chunk):
    monkeypatch.setattr(permutation, "CHUNK", chunk)
    rows = small(3, 4, 2) + [(999, "Z", "R", "L0", 1, 2)]
    geno = spark.createDataFrame(rows, GENO)
    got = {r.test: r for r in permutation.amova_tests(geno, 999).collect()}
    rows = rows[:-1]
    inds = sorted({r[0] for r in rows})
    pop_of = {i: next(r[1] for r in rows if r[0] == i) for i in inds}
    region = np.array([0, 1, 0, 1])
    seen = permutation.amova_parts(counted(rows, pop_of), region)
    near = 1e-12

    def share(values, name):
        return np.mean([v >= phi(seen, *permutation.PHI[name]) - near for v in values])

    moved = [permutation.amova_parts(counted(rows, dict(zip(inds, way))), region) for way in arrangements([pop_of[i] for i in inds])]
    want = {"ST": share([phi(m, *permutation.PHI["ST"]) for m in moved], "ST")}
    inside = [[i for i in inds if pop_of[i] in side] for side in ("AC", "BD")]
    both = itertools.product(*(arrangements([pop_of[i] for i in side]) for side in inside))
    want["SC"] = share([phi(permutation.amova_parts(counted(rows, dict(zip(inside[0] + inside[1], x + y))), region), *permutation.PHI["SC"]) for x, y in both], "SC")
    x = counted(rows, pop_of)
    want["CT"] = share([phi(permutation.amova_parts(x, np.array(way)), *permutation.PHI["CT"]) for way in itertools.permutations(region)], "CT")
    for name, p in want.items():
        assert got[name].phi == pytest.approx(phi(seen, *permutation.PHI[name]), abs=1e-9)
        assert got[name].p == pytest.approx(p, abs=0.05), name
    assert got["IS"].phi == pytest.approx(phi(seen, *permutation.PHI["IS"]), abs=1e-9)
    g, values = np.random.default_rng(5), []
    cells = {}
    for r in rows:
        cells.setdefault((r[1], r[3]), []).append(r)
    for _ in range(3000):
        new = []
        for own in cells.values():
            copies = g.permutation([a for r in own for a in r[4:]])
            new += [(*r[:4], int(copies[2 * k]), int(copies[2 * k + 1])) for k, r in enumerate(own)]
        values.append(phi(permutation.amova_parts(counted(new, pop_of), region), *permutation.PHI["IS"]))
    assert got["IS"].p == pytest.approx(share(values, "IS"), abs=0.05)


def test_components_equal_the_sql_operators(spark):
    rows = small(8, 6, 7, 3)
    data = Dataset(spark, geno=spark.createDataFrame(rows, GENO))
    pop_of = {r[0]: r[1] for r in rows}
    x = counted(rows, pop_of)
    s = permutation.amova_parts(x, np.array([0, 1, 0, 1, 0, 1]))
    want = data.result("amova_hierarchical").first()
    assert tuple(s) == pytest.approx((want.sigma_regions, want.sigma_pops, want.sigma_individuals, want.sigma_within), abs=2e-6)
    flat, want = permutation.amova_parts(x), data.result("amova").first()
    assert tuple(flat[1:]) == pytest.approx((want.sigma_pops, want.sigma_individuals, want.sigma_within), abs=2e-6)
    assert permutation.theta_parts(x) == pytest.approx([sum(r[k] for r in data.result("theta_by_locus").collect()) for k in "abc"], abs=1e-5)


def test_pairwise_tests(spark):
    rows = small(4, 3, 4)
    geno = spark.createDataFrame(rows, GENO)
    got = {(r.p1, r.p2): r for r in permutation.pairwise_tests(geno, 999).collect()}
    assert set(got) == {("A", "B"), ("A", "C"), ("B", "C")}
    for (p, q), r in got.items():
        own = [x for x in rows if x[1] in (p, q)]
        inds = sorted({x[0] for x in own})
        pop_of = {x[0]: x[1] for x in own}
        seen = permutation.theta_parts(counted(own, pop_of))
        values = [permutation.theta_parts(counted(own, dict(zip(inds, way)))) for way in arrangements([pop_of[i] for i in inds])]
        assert r.theta == pytest.approx(phi(seen, (0,), (0, 1, 2)), abs=1e-9)
        assert r.p_theta == pytest.approx(np.mean([phi(v, (0,), (0, 1, 2)) >= r.theta - 1e-12 for v in values]), abs=0.06)
    ordered = sorted(got.values(), key=lambda r: r.p_phi)
    run, want = 0, []
    for k, r in enumerate(ordered):
        run = max(run, min(1, r.p_phi * (3 - k)))
        want.append(run)
    assert [r.p_phi_holm for r in ordered] == pytest.approx(want)


def pair_measures(rows, loci):
    """I_A and r_d from all pairs of individuals; pairs without data take the mean."""
    inds = sorted({r[0] for r in rows})
    of = {(r[0], r[3]): r[4:] for r in rows}
    vectors = []
    for l in loci:
        d = [association.distance(of[i, l], of[j, l]) if (i, l) in of and (j, l) in of else np.nan for i, j in itertools.combinations(inds, 2)]
        vectors.append(np.where(np.isnan(d), np.nanmean(d), d))
    v = [np.var(x, ddof=1) for x in vectors]
    total = np.var(sum(vectors), ddof=1)
    spread = sum(np.sqrt(v[a] * v[b]) for a in range(len(v)) for b in range(a + 1, len(v)))
    pairs = [np.corrcoef(vectors[a], vectors[b])[0, 1] for a in range(len(v)) for b in range(a + 1, len(v))]
    return total / sum(v) - 1, (total - sum(v)) / (2 * spread), pairs


@pytest.mark.parametrize("chunk", [8192, 4])
def test_multilocus_ld_equals_pairs_of_individuals(spark, monkeypatch, chunk):
    monkeypatch.setattr(association, "CHUNK", chunk)
    rows, loci = small(11, 2, 9, 3), ["L0", "L1", "L2"]
    rows += [(i, "T", "R", l, 1, 2) for i in (500, 501) for l in loci]
    geno = spark.createDataFrame(rows, GENO)
    got = {r.pop: r for r in association.multilocus_ld(geno, 99).collect()}
    assert set(got) == {"A", "B", None}
    for pop, r in got.items():
        own = [x for x in rows if pop in (None, x[1])]
        ia, rd, _ = pair_measures(own, loci)
        assert (r.ia, r.rd, r.n_loci, r.n) == pytest.approx((ia, rd, 3, len({x[0] for x in own})), abs=1e-9)
    pairs = {(r.pop, r.l1, r.l2): r.rd for r in association.pairwise_ld(geno, 19, pooled=False).collect()}
    for pop in "AB":
        # A locus of one class in the population has no correlation.
        want = pair_measures([x for x in rows if x[1] == pop], loci)[2]
        assert [np.nan if (v := pairs[pop, a, b]) is None else v for a, b in itertools.combinations(loci, 2)] == pytest.approx(want, abs=1e-9, nan_ok=True)


def test_multilocus_ld_p(spark):
    """p against shuffles of the genotypes themselves."""
    g = np.random.default_rng(2)
    rows = []
    for i in range(12):
        first = sorted(int(x) for x in g.integers(0, 2, 2))
        rows += [(i, "A", "R", "L0", *first), (i, "A", "R", "L1", *(first if g.random() < 0.5 else (0, 1))), (i, "A", "R", "L2", *(int(x) for x in g.integers(0, 2, 2)))]
    (got,) = association.multilocus_ld(spark.createDataFrame(rows, GENO), 999, pooled=False).collect()
    loci, hits = ["L0", "L1", "L2"], 0
    for _ in range(600):
        new = []
        for l in loci:
            own = [r for r in rows if r[3] == l]
            new += [(*r[:4], *own[k][4:]) for r, k in zip(own, g.permutation(12))]
        hits += pair_measures(new, loci)[1] >= got.rd - 1e-12
    assert got.p == pytest.approx(hits / 600, abs=0.06)


def test_subsets_are_uniform_and_exact():
    wanted = np.array([0, 2, 5, 1] * 5000)
    taken = permutation.subsets(5, wanted, np.random.default_rng(3))
    assert (taken.sum(axis=1) == wanted).all()
    got = Counter(tuple(np.flatnonzero(r).tolist()) for r in taken[1::4])
    assert {k: v / 5000 for k, v in got.items()} == pytest.approx({k: 0.1 for k in itertools.combinations(range(5), 2)}, abs=0.02)


@pytest.mark.parametrize("block, wide", [(1 << 15, 512), (2, 0)])
def test_pairs_of_populations_deal_each_individual_once(spark, monkeypatch, block, wide):
    """Chunks and blocks of a population, and two blocks of loci, against all arrangements; individuals leave for one chunk, not for one a pair."""
    monkeypatch.setattr(permutation, "CHUNK", 2)
    monkeypatch.setattr(permutation, "BLOCK", block)
    monkeypatch.setattr(permutation, "WIDE", wide)
    monkeypatch.setattr(permutation, "CELLS", 16)
    rows = small(4, 3, 4, 3)
    geno = spark.createDataFrame(rows, GENO)
    inds, pops, _, _ = permutation.populations(geno)
    coded = permutation.Coded(geno, 2)
    assert coded.blocks > 1
    met = []
    monkeypatch.setattr(permutation, "kept", lambda df: met.append(df) or df)
    counts = permutation.paired_counts(inds, coded, 50)
    assert met[0].count() == inds.count() == 12
    assert counts.where("b = 0").select("name", "block").distinct().count() == 3 * coded.alleles.select("block").distinct().count()
    got = {(r.p1, r.p2): r for r in permutation.pairwise_tests(geno, 999).collect()}
    for (p, q), r in got.items():
        own = [x for x in rows if x[1] in (p, q)]
        inds_ = sorted({x[0] for x in own})
        pop_of = {x[0]: x[1] for x in own}
        values = [permutation.theta_parts(counted(own, dict(zip(inds_, way)))) for way in arrangements([pop_of[i] for i in inds_])]
        seen = permutation.theta_parts(counted(own, pop_of))
        assert r.theta == pytest.approx(phi(seen, (0,), (0, 1, 2)), abs=1e-9)
        assert r.p_theta == pytest.approx(np.mean([phi(v, (0,), (0, 1, 2)) >= r.theta - 1e-12 for v in values]), abs=0.06)


def test_labels_are_arranged_evenly(monkeypatch):
    """Labels drawn one by one and mended: exact numbers, every order as likely as another, and no shuffle of all places."""
    monkeypatch.setattr(permutation, "MANY", 0)
    g = np.random.default_rng(8)
    got = Counter(tuple(permutation.arranged(np.array([2, 0, 1, 1]), g).tolist()) for _ in range(12_000))
    assert set(got) == arrangements([0, 0, 2, 3])
    assert np.array(list(got.values())) / 12_000 == pytest.approx(1 / 12, abs=0.012)
    counts = np.array([50_000, 1, 0, 29_999, 20_000])
    one, two = (permutation.arranged(counts, g) for _ in range(2))
    assert one.itemsize == 1 and (np.bincount(one, minlength=5) == counts).all()
    met = np.bincount(one * 5 + two, minlength=25).reshape(5, 5)
    assert met == pytest.approx(np.outer(counts, counts) / 100_000, abs=700)
    assert np.bincount(one[:50_000], minlength=5) == pytest.approx(counts / 2, abs=700)


def test_tables_count_several_loci_at_once():
    g = np.random.default_rng(6)
    assert association.gathered(7, 3) == [[0, 1, 2], [0, 3, 4], [0, 5, 6], [1, 3, 5], [1, 4, 6], [2, 3, 6], [2, 4, 5]]
    for loci, n, width in ((7, 70_000, 22), (7, 500, 22), (6, 40_000, 5), (5, 3000, 3), (2, 900, 4), (1, 50, 3)):
        codes = g.integers(0, width, (loci, n)).astype(np.uint8)
        want = np.array([np.bincount(codes[a].astype(int) * width + codes[b], minlength=width * width).reshape(width, width) for a, b in itertools.combinations(range(loci), 2)]).reshape(-1, width, width)
        assert (association.tables(codes, width) == want).all()
