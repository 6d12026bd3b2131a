"""The shared SQL on hand-checkable data: values are exact fractions worked out from the formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.dataset import QUERIES, Dataset, duck_sql
from popspark.functions import special
from popspark.operators import matrices, multiple, resampling
from popspark.plans import registry

M1 = [(1, "A", 1, 1), (2, "A", 1, 2), (3, "A", 2, 2), (4, "B", 1, 2), (5, "B", 2, 2), (6, "B", 2, 2)]
M2 = [(1, "A", 1, 1), (2, "A", 1, 1), (3, "A", 1, 2), (4, "B", 1, 2), (5, "B", 2, 2), (6, "B", 2, 2)]


def dataset(spark, rows):
    geno = spark.createDataFrame([(i, p, "R", 1, a, b) for i, p, a, b in rows], "ind bigint, pop string, region string, locus int, a1 bigint, a2 bigint")
    return Dataset(spark, geno=geno)


@pytest.fixture(scope="module")
def m1(spark):
    return dataset(spark, M1)


@pytest.fixture(scope="module")
def m2(spark):
    return dataset(spark, M2)


def test_cells(m1):
    got = {r["pop"]: r for r in m1.result("diversity_cells").collect()}
    assert [got["A"][c] for c in ("n", "na", "ho", "he", "uhe", "f", "pic")] == pytest.approx([3, 2, 1 / 3, 1 / 2, 3 / 5, 1 / 3, 0.375], abs=1e-6)
    assert [got["B"][c] for c in ("ho", "he", "uhe", "f", "pic")] == pytest.approx([1 / 3, 5 / 18, 1 / 3, -1 / 5, 0.239198], abs=1e-6)


def test_hardy_weinberg(m1):
    got = {r["pop"]: r for r in m1.result("hwe_chi_square").collect()}
    assert got["A"]["chi2"] == pytest.approx(1 / 3, abs=1e-6) and got["B"]["chi2"] == pytest.approx(0.12, abs=1e-6)
    nei = {r["pop"]: r for r in m1.result("fis_nei_chesser").collect()}
    assert (nei["A"]["hs"], nei["A"]["f"], nei["B"]["f"]) == pytest.approx((2 / 3, 1 / 2, 0), abs=1e-6)


def test_theta_and_amova(m1, m2):
    one, two = m1.result("theta_by_locus").first(), m2.result("theta_by_locus").first()
    assert (one["a"], one["b"], one["c"]) == pytest.approx((0, 1 / 6, 1 / 3), abs=1e-6)
    assert (two["a"], two["b"], two["c"], two["theta"]) == pytest.approx((7 / 18, 0, 1 / 3, 0.538462), abs=1e-6)
    one, two = m1.result("amova").first(), m2.result("amova").first()
    assert [one[c] for c in ("ss_total", "ss_pops", "ss_individuals", "ss_within", "phi_st", "phi_is", "phi_it")] == pytest.approx([8 / 3, 1 / 3, 4 / 3, 1, 0, 1 / 3, 1 / 3], abs=1e-6)
    assert [two[c] for c in ("ss_total", "ss_pops", "sigma_pops", "sigma_individuals", "sigma_within", "phi_st")] == pytest.approx([3, 4 / 3, 7 / 36, 0, 1 / 6, 0.538462], abs=1e-6)


def test_nei(m2):
    got = m2.result("nei_by_locus").first()
    assert [got[c] for c in ("hs", "ht", "gst", "gst_hedrick", "jost_d")] == pytest.approx([1 / 3, 19 / 36, 0.368421, 0.736842, 0.583333], abs=1e-6)
    assert m2.result("pairwise_theta").first()["theta"] == pytest.approx(0.538462, abs=1e-6)
    assert m2.result("pairwise_gst").first()["jost_d"] == pytest.approx(0.583333, abs=1e-6)


def test_distances(m1, m2):
    names = ("nei72", "nei78", "chord", "reynolds", "rogers", "prevosti")
    assert [m1.result("population_distances").first()[c] for c in names] == pytest.approx([0.183862, 0.032269, 0.230993, 0.471405, 1 / 3, 1 / 3], abs=1e-6)
    assert [m2.result("population_distances").first()[c] for c in names] == pytest.approx([0.955511, 0.875469, 0.454320, 0.784465, 2 / 3, 2 / 3], abs=1e-6)


def test_demography_by_locus(spark):
    """Worked out by hand: L1 has p = 1/2 and 4 of 6 heterozygotes, L2 p = 1/4 of 3 heterozygotes, L3 is fixed, L4 has four individuals."""
    rows = [(i, "A", "R", "L1", a, b) for i, (a, b) in enumerate([(10, 14)] * 4 + [(10, 10), (14, 14)])]
    rows += [(i, "A", "R", "L2", a, b) for i, (a, b) in enumerate([(20, 22)] * 3 + [(22, 22)] * 3)]
    rows += [(i, "A", "R", "L3", 30, 30) for i in range(6)] + [(i, "A", "R", "L4", 40, 42) for i in range(4)]
    data = Dataset(spark, geno=spark.createDataFrame(rows, "ind bigint, pop string, region string, locus string, a1 bigint, a2 bigint"))
    got = data.result("ne_heterozygote_excess").first()
    d1, d2 = (4 / 6) / (12 / 11 * 1 / 2) - 1, (3 / 6) / (12 / 11 * 3 / 8) - 1
    d = (d1 + d2) / 2
    assert (got.n_loci, got.d, got.ne) == pytest.approx((2, d, 1 / (2 * d) + 1 / (2 * (d + 1))), abs=1e-5)
    assert got.ne_low is None and got.ne_high is None
    assert {x.locus: x.m for x in data.result("m_ratio").collect()} == pytest.approx({"L1": 2 / 5, "L2": 2 / 3, "L4": 2 / 3}, abs=1e-6)
    # Frequencies 1/2, 1/2, 1/4, 3/4, 1, 1/2, 1/2 fall in classes 5, 5, 2, 7, 9, 5, 5.
    assert {x["class"]: x.n for x in data.result("mode_shift").collect()} == {5: 4, 2: 1, 7: 1, 9: 1}


def test_clones_of_any_loci(spark):
    rows = [(i, "A", "R", f"M{k}", *((1, 2) if (i, k) != (3, 4) else (2, 2))) for i in (1, 2, 3) for k in range(5)]
    rows += [(4, "A", "R", f"M{k}", 2, 1) for k in range(5)] + [(5, "A", "R", f"M{k}", 1, 2) for k in range(3)]
    data = Dataset(spark, geno=spark.createDataFrame(rows, "ind bigint, pop string, region string, locus string, a1 bigint, a2 bigint"))
    assert sorted(tuple(x) for x in data.result("clones").collect()) == [(2, 1), (4, 1)]


def test_homogeneity_of_every_locus(spark):
    tables = spark.createDataFrame([(1, 5.0, 1), (2, 6.0, 2), (3, 0.4, 3), (4, 0.0, 0)], "locus int, chi2 double, df int")
    want = {k: special.gamma_tail(df / 2, chi2 / 2) for k, chi2, df in ((1, 5.0, 1), (2, 6.0, 2), (3, 0.4, 3))}
    assert {r["locus"]: r["p"] for r in multiple.genic_differentiation(tables).collect()} == pytest.approx(want, abs=1e-6)
    got = {r["locus"]: r for r in multiple.adjusted_p(tables).collect()}
    assert [got[k]["holm"] for k in (1, 2, 3)] == pytest.approx([3 * want[1], 2 * want[2], want[3]], abs=1e-5)
    assert [got[k]["bh"] for k in (1, 2, 3)] == pytest.approx([1.5 * want[2], 1.5 * want[2], want[3]], abs=1e-5)
    one = multiple.fisher_combined(tables).first()
    assert one["df"] == 6 and one["chi2"] == pytest.approx(-2 * sum(map(math.log, want.values())), abs=1e-5)


def test_sequences_of_any_id_and_site(spark):
    rnd = np.random.default_rng(6)
    seqs = {1000 + 7 * i: ("ABC"[i % 3], "".join(rnd.choice(list("ACGT"), 9, p=[0.7, 0.1, 0.1, 0.1]))) for i in range(24)}
    seqs[5000] = ("A", seqs[1000][1])
    sites = spark.createDataFrame([(i, p, k + 1, b) for i, (p, s) in seqs.items() for k, b in enumerate(s)], "ind bigint, pop string, site int, base string")
    data = Dataset(spark, sites=sites)
    ids, d = sorted(seqs), lambda i, j: sum(x != y for x, y in zip(seqs[i][1], seqs[j][1]))
    within = lambda p, q: [d(i, j) for i in ids for j in ids if (i < j or p != q) and seqs[i][0] == p and seqs[j][0] == q]
    for row in data.result("dxy_da").collect():
        x, a, b = (np.mean(within(*k)) for k in ((row["p1"], row["p2"]), (row["p1"], row["p1"]), (row["p2"], row["p2"])))
        assert (row["dxy"], row["da"]) == pytest.approx((x / 9, max(0, x - (a + b) / 2) / 9), abs=1e-6)
    n, sizes = len(ids), [sum(p == q for p, _ in seqs.values()) for q in "ABC"]
    sst, ssw = sum(d(i, j) for i in ids for j in ids if i < j) / n, sum(sum(within(q, q)) / m for q, m in zip("ABC", sizes))
    msw, n0 = ssw / (n - 3), (n - sum(m * m for m in sizes) / n) / 2
    sb = ((sst - ssw) / 2 - msw) / n0
    assert data.result("phi_st_sequences").first()["phi_st"] == pytest.approx(sb / (sb + msw), abs=1e-6)
    assert data.result("k2p_distance").count() == n * (n - 1) / 2
    assert {r["h"]: r["n"] for r in data.result("haplotypes").collect()} == {s: sum(t == s for _, t in seqs.values()) for _, s in seqs.values()}
    haps = sorted({s for _, s in seqs.values()})
    f = np.array([[sum((p, s) == (q, h) for p, s in seqs.values()) / m for h in haps] for q, m in zip("ABC", sizes)])
    diff, m, e = np.array([[sum(x != y for x, y in zip(g, h)) for h in haps] for g in haps]), f.mean(axis=0), f - f.mean(axis=0)
    vs = np.mean([k / (k - 1) * (v @ diff @ v) for k, v in zip(sizes, f)])
    got = data.result("pons_petit").first()
    assert (got["vs"], got["vt"]) == pytest.approx((vs, m @ diff @ m - sum(v @ diff @ v for v in e) / 6), abs=1e-6)


def test_every_individual_of_every_population(spark):
    rnd = np.random.default_rng(4)
    rows = [(1001 + 2 * i, "PQ"[i % 2], "R", l, int(rnd.integers(3)), int(rnd.integers(3))) for i in range(14) for l in (1, 2, 3, 4)]
    geno = spark.createDataFrame(rows, "ind bigint, pop string, region string, locus int, a1 bigint, a2 bigint")
    flat = lambda name: spark.createDataFrame([(1000 + i, "P", name, int(rnd.integers(2))) for i in range(6)], f"ind bigint, pop string, {name} string, x int")
    places = spark.createDataFrame([(1000 + i, "P", float(i), 2.0 * i) for i in range(6)], "ind bigint, pop string, lat double, lon double")
    data = Dataset(spark, geno=geno, bands=flat("band"), hap=flat("locus").withColumnRenamed("x", "allele"), traits=flat("trait").withColumnRenamed("x", "v"), places=places)
    of = {i: {r[3]: r[4:] for r in rows if r[0] == i} for i in {r[0] for r in rows}}
    shared = lambda x, y: 2 if sorted(x) == sorted(y) else int(bool(set(x) & set(y)))
    pairs = {p: [(i, j) for i in sorted(of) for j in sorted(of) if i < j and (i, p) in {r[:2] for r in rows} and (j, p) in {r[:2] for r in rows}] for p in "PQ"}
    got = {(r["i"], r["j"]): r["dps"] for r in data.result("individual_distances").collect()}
    assert got == pytest.approx({(i, j): np.mean([1 - shared(of[i][l], of[j][l]) / 2 for l in of[i]]) for p in "PQ" for i, j in pairs[p]}, abs=1e-6)
    assert {(r["i"], r["j"]) for r in data.result("loiselle_kinship").collect()} == set(got)
    d = {p: np.array([[2 - shared(of[i][l], of[j][l]) for l in (1, 2, 3, 4)] for i, j in pairs[p]]) for p in "PQ"}
    ia = {p: np.var(v.sum(axis=1), ddof=1) / np.var(v, axis=0, ddof=1).sum() - 1 for p, v in d.items()}
    assert {r["pop"]: r["ia"] for r in data.result("index_of_association").collect()} == pytest.approx(ia, abs=1e-6)
    rd = {(r["pop"], r["l1"], r["l2"]): r["rd"] for r in data.result("pairwise_rd").collect()}
    assert len(rd) == 12 and rd["Q", 1, 3] == pytest.approx(np.corrcoef(d["Q"][:, 0], d["Q"][:, 2])[0, 1], abs=1e-6)
    assert all(data.result(name).count() == 15 for name in ("band_distances", "gower", "haploid_p_distance"))
    assert data.result("assignment").count() == 14 and sum(r["n"] for r in data.result("assignment_matrix").collect()) == 14


def test_empty_data(spark):
    empty = dataset(spark, [])
    for name in ("diversity_cells", "theta_by_locus", "population_distances", "locus_qc"):
        assert empty.result(name).count() == 0


def test_every_query_has_a_statement_for_duckdb():
    assert len(QUERIES) > 70
    assert all("$" not in duck_sql(name) for name in QUERIES)


def test_special_functions():
    assert special.gamma_tail(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-12)
    assert special.gamma_tail(5, 9.1551) == pytest.approx(sum(math.exp(-9.1551) * 9.1551**i / math.factorial(i) for i in range(5)), rel=1e-12)
    assert special.beta_part(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)
    assert special.normal_tail(1.959963984540054) == pytest.approx(0.025, abs=1e-12)


def test_exact_test_and_null_alleles(spark):
    rows = [(i, "P", 1, 1 + i % 2, 1 + i % 2) for i in range(20)] + [(i, "Q", 1, 1, 2 if i % 2 else 1) for i in range(20)]
    geno = spark.createDataFrame(rows, "ind bigint, pop string, locus int, a1 bigint, a2 bigint")
    got = {r["pop"]: r for r in resampling.hwe_exact(geno, 500).collect()}
    assert got["P"]["p"] < 0.01 and got["P"]["p_deficit"] < 0.01 and got["P"]["p_excess"] == 1 and got["Q"]["p"] > 0.2
    again = {r["pop"]: r for r in resampling.hwe_exact(geno.repartition(3), 500).collect()}
    assert again == got
    tables = geno.groupBy("pop", "locus", geno.a1.alias("a"), geno.a2.alias("b")).count().withColumnRenamed("count", "n")
    nulls = {r["pop"]: r["r"] for r in resampling.null_alleles_em(tables).collect()}
    assert nulls["P"] > 0.2 and nulls["Q"] < 0.01


def test_permuted_theta(spark):
    far = [(i, "P" if i < 12 else "Q", l, 1 if i < 12 else 2, 1 + (i + l) % 2) for i in range(24) for l in (1, 2)]
    geno = spark.createDataFrame(far, "ind bigint, pop string, locus int, a1 bigint, a2 bigint")
    got = resampling.permuted_theta(geno, 39).first()
    want = Dataset(spark, geno=geno.selectExpr("ind", "pop", "1 AS region", "locus", "a1", "a2")).result("theta_multilocus").first()
    assert got["theta"] == pytest.approx(want["theta"], abs=1e-5) and got["p"] == pytest.approx(1 / 40)


def test_registered_replicates_and_numbers(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(registry, "relation", lambda *a: spark.range(1))
    monkeypatch.setattr(registry, "from_tables", lambda *a: spark.createDataFrame([(1, 2, 0.1)], f"p1 int, p2 int, {a[2].split(chr(95))[1]} double"))
    for name in ("permuted_theta", "mantel", "hwe_exact"):
        monkeypatch.setattr(resampling, name, lambda df, n, name=name: seen.update({name: n}))
    for f in (registry.permuted_theta, registry.mantel_distance, registry.hwe_exact):
        f(spark, "")
    assert seen == {"permuted_theta": 999, "mantel": 999, "hwe_exact": 1000}
    rows = spark.range(500).selectExpr("id AS ind", "CAST(id % 2 AS INT) AS b")
    got = resampling.numbered(rows, ["b"], F.xxhash64("b", "ind")).collect()
    assert sorted((r["b"], r["k"]) for r in got) == [(b, k) for b in (0, 1) for k in range(1, 251)]


def test_mantel(spark):
    pairs = [(i, j, float(abs(i - j)), float(abs(i - j)) + 0.1 * ((i * j) % 3)) for i in range(8) for j in range(i)]
    got = resampling.mantel(spark.createDataFrame(pairs, "p1 int, p2 int, x double, y double"), 99, 20).first()
    assert got["r"] > 0.95 and got["p"] == pytest.approx(0.01)


def test_trees_and_ordination(spark):
    # An additive tree: neighbour joining finds its splits and path lengths.
    d = {("a", "b"): 3, ("a", "c"): 6, ("a", "d"): 7, ("b", "c"): 7, ("b", "d"): 8, ("c", "d"): 5}
    pairs = spark.createDataFrame([("t", x, y, float(v)) for (x, y), v in d.items()], "tree string, p1 string, p2 string, d double")
    text = matrices.neighbour_joining(pairs).first()["newick"]
    assert text.count("(") == 3 and ("(a:1.0,b:2.0)" in text or "(c:2.0,d:3.0)" in text)
    assert matrices.upgma(pairs).first()["newick"].startswith("(")
    points = np.array([[0.0, 0], [3, 0], [0, 4], [3, 4]])
    rows = [("m", str(i), str(j), float(np.linalg.norm(points[i] - points[j]))) for i in range(4) for j in range(i)]
    axes = {r["label"]: r["axes"] for r in matrices.pcoa(spark.createDataFrame(rows, "tree string, p1 string, p2 string, d double")).collect()}
    for i in range(4):
        for j in range(i):
            assert np.linalg.norm(np.array(axes[str(i)]) - np.array(axes[str(j)])) == pytest.approx(np.linalg.norm(points[i] - points[j]), abs=1e-9)
