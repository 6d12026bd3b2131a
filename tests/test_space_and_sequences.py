"""Kinship in space, sequence sites, haploid theta and intervals against plain Python on small random data."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest

from popspark.dataset import Dataset
from popspark.operators import neutrality

GENO = "ind bigint, pop string, region string, locus int, a1 bigint, a2 bigint"


@pytest.fixture(scope="module")
def genotypes():
    draw = random.Random(5)
    sizes = {"A": 14, "B": 9, "C": 4}
    rows, ind = [], 0
    for pop, n in sizes.items():
        for _ in range(n):
            rows += [(ind, pop, "R", locus, draw.randint(1, 3), draw.randint(1, 3)) for locus in range(4) if draw.random() < 0.9]
            ind += 1
    # One individual without a place, one pair at the same place.
    spots = {i: (draw.uniform(-1, 1), draw.uniform(-1, 1)) for i in range(ind) if i != 3}
    spots[5] = spots[6]
    return rows, spots


@pytest.fixture(scope="module")
def mapped(spark, genotypes):
    rows, spots = genotypes
    places = [(i, "?", a, b) for i, (a, b) in spots.items()] + [(3, "?", None, 1.0)]
    return Dataset(spark, geno=spark.createDataFrame(rows, GENO), places=spark.createDataFrame(places, "ind bigint, pop string, lat double, lon double"))


def kinship(rows):
    """Each pair's numerator and denominator, allele by allele, with frequencies of the given rows."""
    of = {(r[0], r[3]): r[4:6] for r in rows}
    counts = {}
    for r in rows:
        counts.setdefault(r[3], Counter()).update(r[4:6])
    out = {}
    for i, j in combinations(sorted({r[0] for r in rows}), 2):
        num = den = 0.0
        for locus, c in counts.items():
            if (i, locus) in of and (j, locus) in of:
                n = sum(c.values())
                for allele, k in c.items():
                    p = k / n
                    x, y = of[i, locus].count(allele) / 2, of[j, locus].count(allele) / 2
                    num += (x - p) * (y - p) + p * (1 - p) / (n - 1)
                    den += p * (1 - p)
        if den:
            out[i, j] = num / den
    return out


def km(a, b):
    (lat1, lon1), (lat2, lon2) = ((math.radians(v) for v in p) for p in (a, b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def mapped_pairs(rows, spots):
    found = []
    for pop in ("A", "B", "C"):
        own = [r for r in rows if r[1] == pop and r[0] in spots]
        if len({r[0] for r in own}) >= 5:
            found += [(km(spots[i], spots[j]), k) for (i, j), k in kinship(own).items() if spots[i] != spots[j]]
    return sorted(found)


def test_kinship_of_all_pairs(mapped, genotypes):
    want = {}
    for pop in ("A", "B", "C"):
        want |= kinship([r for r in genotypes[0] if r[1] == pop])
    got = {(r["i"], r["j"]): r["kinship"] for r in mapped.result("loiselle_kinship").collect() if r["kinship"] is not None}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-5) for x in want)


def test_correlogram_and_slope(mapped, genotypes):
    pairs = mapped_pairs(*genotypes)
    n = len(pairs)
    per = math.ceil(n / max(2, min(10, n // 30)))
    classes = [pairs[a : a + per] for a in range(0, n, per)]
    got = sorted(mapped.result("correlogram").collect(), key=lambda r: r["class"])
    assert [r["n"] for r in got] == [len(c) for c in classes]
    for r, c in zip(got, classes):
        assert r["low_km"] == pytest.approx(c[0][0], abs=1e-5) and r["high_km"] == pytest.approx(c[-1][0], abs=1e-5)
        assert r["kinship"] == pytest.approx(sum(k for _, k in c) / len(c), abs=1e-5)
    x, y = [math.log(d) for d, _ in pairs], [k for _, k in pairs]
    mx, my = sum(x) / n, sum(y) / n
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    first = sum(k for _, k in classes[0]) / len(classes[0])
    row = mapped.result("kinship_slope").first()
    assert row["n"] == n and row["slope"] == pytest.approx(slope, abs=1e-5) and row["sp"] == pytest.approx(-slope / (1 - first), abs=1e-5)


def test_few_pairs_have_no_classes(spark):
    geno = spark.createDataFrame([(i, "A", "R", 1, 1, 2) for i in range(6)], GENO)
    places = spark.createDataFrame([(i, "A", float(i), 0.0) for i in range(6)], "ind bigint, pop string, lat double, lon double")
    assert Dataset(spark, geno=geno, places=places).result("correlogram").count() == 0


ALIGNED = ["ACGTAC-T", "ACGTACGT", "ATGTACGN", "ATGAACGT", "ATGAACGT", "ACGTACGT"]


@pytest.fixture(scope="module")
def aligned(spark):
    rows = [(i, "A" if i < 4 else "B", site + 1, base) for i, seq in enumerate(ALIGNED) for site, base in enumerate(seq)]
    # A site that one sequence lacks.
    rows += [(i, "A" if i < 4 else "B", 9, "AC"[i % 2]) for i in range(5)]
    return Dataset(spark, sites=spark.createDataFrame(rows, "ind bigint, pop string, site int, base string"))


def test_sites_are_deleted_whole(aligned):
    got = {r["pop"]: r for r in aligned.result("site_summary").collect()}
    assert got["A"]["sites"] == 6 and got["A"]["segregating"] == 2 and got["B"]["segregating"] == 2
    assert {r["h"]: (r["n_pops"], r["n"]) for r in aligned.result("haplotypes").collect()} == {"ACGTAC": (2, 3), "ATGTAC": (1, 1), "ATGAAC": (2, 2)}
    assert {(r["pop"], r["h"]): r["private"] for r in aligned.result("haplotype_table").collect()}["A", "ATGTAC"]


def test_mismatches_through_haplotypes(aligned):
    want = {}
    for pop, members in (("A", range(4)), ("B", (4, 5))):
        seqs = ["".join(ALIGNED[i][s] for s in (0, 1, 2, 3, 4, 5)) for i in members]
        d = Counter(sum(x != y for x, y in zip(a, b)) for a, b in combinations(seqs, 2))
        want |= {(pop, k): n / d.total() for k, n in d.items()}
    got = {(r["pop"], r["d"]): r["f"] for r in aligned.result("mismatch_distribution").collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-6) for x in want)


@pytest.mark.parametrize("n, k, theta", [(2, 1, 0.5), (7, 3, 2.5), (12, 12, 4.0), (30, 9, 1.25)])
def test_fu_fs(n, k, theta):
    stirling = [1]
    for m in range(n):
        stirling = [(stirling[j - 1] if j else 0) + m * (stirling[j] if j < len(stirling) else 0) for j in range(len(stirling) + 1)]
    total = math.prod(theta + i for i in range(n))
    s = sum(stirling[j] * theta**j for j in range(k, n + 1)) / total
    s = min(1 - 1e-12, max(1e-12, s))
    assert neutrality.fs_of(n, k, theta) == pytest.approx(math.log(s / (1 - s)), rel=1e-6)


def test_haploid_theta(spark):
    draw = random.Random(2)
    rows = [(i, pop, "L", draw.choice(letters)) for i, (pop, letters) in enumerate([("A", "xy")] * 5 + [("B", "yz")] * 7 + [("C", "xyz")] * 4 + [("D", "x")])]
    rows.append((99, "A", "L", None))
    # By the definition, with a row for every population and allele.
    pops = {p: [r[3] for r in rows if r[1] == p and r[3]] for p in "ABC"}
    n = {p: len(v) for p, v in pops.items()}
    r, nb = len(n), sum(n.values()) / len(n)
    nc = (r * nb - sum(v * v for v in n.values()) / (r * nb)) / (r - 1)
    a = b = 0.0
    for allele in "xyz":
        p = {q: pops[q].count(allele) / n[q] for q in pops}
        mean = sum(n[q] * p[q] for q in pops) / (r * nb)
        s2 = sum(n[q] * (p[q] - mean) ** 2 for q in pops) / ((r - 1) * nb)
        a += nb / nc * (s2 - (mean * (1 - mean) - (r - 1) / r * s2) / (nb - 1))
        b += nb / (nb - 1) * (mean * (1 - mean) - (r - 1) / r * s2)
    data = Dataset(spark, hap=spark.createDataFrame(rows, "ind bigint, pop string, locus string, allele string"))
    assert data.result("haploid_theta").first()["theta"] == pytest.approx(a / (a + b), abs=1e-6)
    assert data.result("haploid_theta_by_locus").first()["a"] == pytest.approx(a, abs=1e-6)


def test_intervals_hold_the_estimate(mapped):
    cells = mapped.result("diversity_cells").toPandas()
    for row in mapped.result("diversity_intervals").collect():
        own = cells[cells["pop"] == row["pop"]]
        assert own["he"].min() <= row["he_low"] <= own["he"].mean() <= row["he_high"] <= own["he"].max()
    whole = {r["pop"]: r["f"] for r in mapped.result("fis_multilocus").collect()}
    limits = {r["pop"]: (r["f_low"], r["f_high"]) for r in mapped.result("fis_intervals").collect()}
    assert limits.keys() == whole.keys() and all(limits[p][0] <= whole[p] <= limits[p][1] for p in whole)
