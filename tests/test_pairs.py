"""Pairs by blocks against the SQL of the same queries, on rows that repeat, nulls and ids of any kind."""

import duckdb
import numpy as np
import pytest

from popspark.dataset import QUERIES, Dataset, duck_sql
from popspark.operators import pairs
from popspark.plans.compose import statement


@pytest.fixture(scope="module")
def odd(spark):
    g = np.random.default_rng(11)
    pick = lambda *v: v[int(g.integers(len(v)))]
    geno = [(100 + 7 * i, pick("A", "A", "B"), "R", l, pick(1, 1, 2, 3), pick(1, 2, 2, 3)) for i in range(30) for l in range(1, 8) if g.random() < 0.8]
    geno += [(*geno[0][:4], 2, 3), (*geno[9][:5], None), (*geno[12][:4], None, None), (None, "A", "R", 1, 1, 1), (900, None, "R", 1, 1, 1), (901, "A", "R", None, 1, 2), (902, "B", "R", 99, 1, 2)]
    bands = [(f"n{i}", "P", b, pick(0, 1, 1, None)) for i in range(20) for b in "uvwxyz" if g.random() < 0.8] + [("n1", "P", "u", 1), ("n2", "P", None, 1), (None, "P", "u", 1), ("lone", "P", "v", None)]
    hap = [(i, "P", l, pick("a", "b", "c", None)) for i in range(20) for l in "xyz" if g.random() < 0.8] + [(3, "P", "x", "b"), (4, "P", None, "a"), (None, "P", "x", "a")]
    traits = [(i, "P", t, pick(None, float(g.normal()))) for i in range(20) for t in ("s", "t", "u") if g.random() < 0.8] + [(3, "P", "s", 2.5), (4, "P", None, 1.0), (None, "P", "s", 1.0), (5, "P", "flat", 1.0), (6, "P", "flat", 1.0), (70, "P", "none", None), (71, "P", "none", None)]
    sites = [(i, "AB"[i % 2], s, pick("A", "A", "C", "G", "T", "-", None)) for i in range(16) for s in range(1, 12) if g.random() < 0.9] + [(3, "B", 2, "G"), (None, "A", 1, "A"), (5, "B", None, "A"), (80, "A", 50, "A"), (81, "A", 50, None)]
    make = spark.createDataFrame
    return Dataset(
        spark,
        geno=make(geno, "ind bigint, pop string, region string, locus int, a1 bigint, a2 bigint"),
        bands=make(bands, "ind string, pop string, band string, x int"),
        hap=make(hap, "ind bigint, pop string, locus string, allele string"),
        traits=make(traits, "ind bigint, pop string, trait string, v double"),
        sites=make(sites, "ind bigint, pop string, site int, base string"),
    )


def told(df):
    """Rows in order; a pair of two populations has two."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, round(x, 4) if isinstance(x, float) else x) for x in r])


def test_near_clones(spark):
    """One genotype in 19 of 20 loci, in 4 of 4; not in 3 of 3, nor across populations."""
    many = [(i, p, "R", l, 1, 2 if (i, l) != (2, 20) else 3) for i, p in ((1, "A"), (2, "A"), (3, "B")) for l in range(1, 21)]
    few = [(i, "C", "R", l, *(a[::-1] if i == 5 else a)) for i, k in ((4, 4), (5, 4), (6, 3)) for l, a in zip(range(k), [(1, 2), (2, 2), (1, 3), (3, 3)])]
    geno = spark.createDataFrame(many + few, "ind bigint, pop string, region string, locus int, a1 bigint, a2 bigint")
    assert told(Dataset(spark, geno=geno).result("near_clones")) == [(1, 2, 20, 0.95), (4, 5, 4, 1.0)]


@pytest.mark.parametrize("small", [1024, 6])
@pytest.mark.parametrize("name", sorted(pairs.PAIRS))
def test_blocks_equal_the_sql(odd, monkeypatch, name, small):
    monkeypatch.setattr(pairs, "SMALL", small)
    monkeypatch.setattr(pairs, "SITES", 4)
    monkeypatch.setattr(pairs, "TALL", 5)
    want, got = told(odd.sql(QUERIES[name])), told(odd.result(name))
    assert len(want) > 10 or name == "near_clones"
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(g == pytest.approx(w, abs=2e-6) for g, w in zip(got, want, strict=True))
    assert odd.result(name).columns == odd.sql(QUERIES[name]).columns


@pytest.mark.parametrize("small", [1024, 4])
@pytest.mark.parametrize("name", sorted(pairs.MADE))
def test_mismatches_equal_the_sql(spark, monkeypatch, name, small):
    monkeypatch.setattr(pairs, "SMALL", small)
    monkeypatch.setattr(pairs, "SITES", 4)
    g = np.random.default_rng(3)
    pop = lambda i: [None, "A", "B", "C"][min(i % 7, 3)]
    rows = [(i, pop(i), s, "ACGT"[int(g.integers(4)) * int(g.random() < 0.3)]) for i in range(40) for s in range(1, 10)]
    # Site 10: one sequence twice, one not at all.
    rows += [(i, pop(i), 10, "AC"[i % 2]) for i in [*range(39), 3]]
    data = Dataset(spark, sites=spark.createDataFrame(rows, "ind bigint, pop string, site int, base string"))
    want = told(data.sql(QUERIES[name]))
    assert len(want) >= 3
    assert told(data.result(name)) == want


def test_association_equals_the_sql(odd):
    """Missing loci, null alleles, genotypes that repeat; in DuckDB. ``ld_loci`` as linkage.py has it: tables.py names another step so."""
    duck = duckdb.connect()
    duck.execute("CREATE TABLE g (ind BIGINT, pop VARCHAR, region VARCHAR, locus INT, a1 BIGINT, a2 BIGINT)")
    duck.executemany("INSERT INTO g VALUES (?, ?, ?, ?, ?, ?)", [tuple(r) for r in odd.relations["geno"].collect()])
    for name in ("index_of_association", "pairwise_rd"):
        want = sorted(duck.execute(statement(QUERIES[name], "duckdb", {"geno": "SELECT * FROM g", "ld_loci": "SELECT DISTINCT pop, locus FROM geno"})).fetchall())
        got = sorted(tuple(r) for r in odd.result(name).collect())
        assert [r[:-2] for r in got] == [r[:-2] for r in want]
        assert len(want) >= 2
        for g, w in zip(got, want, strict=True):
            assert g == pytest.approx(tuple(None if v != v else v for v in w), abs=2e-6)


def test_association_forms_no_pairs(spark):
    """A population of 20,000 has 200 million pairs; the joins of pairs did not end on it."""
    geno = spark.range(20000).selectExpr("id AS ind", "'A' AS pop", "'R' AS region", "explode(array(1, 2, 3)) AS locus").selectExpr("*", "(ind * locus * 7919 >> 3) % 4 AS a1", "(ind * locus * 104729 >> 5) % 3 AS a2")
    data = Dataset(spark, geno=geno)
    assert data.result("pairwise_rd").count() == 3
    assert data.result("index_of_association").first()["ia"] is not None


def test_the_registered_pairs_are_all_pairs():
    for name in ("individual_distances", "loiselle_kinship", "band_distances", "gower", "haploid_p_distance", "k2p_distance"):
        assert "% 100" not in duck_sql(name)


def test_near_clones_compares_copies_once(odd, spark, monkeypatch):
    """Copies with ids between and beyond, alleles in either order, rows that repeat and null alleles; each set of genotypes meets others once."""
    geno = [tuple(r) for r in odd.relations["geno"].collect()]
    geno = [(ind and 10 * ind + c, pop, reg, l, *((a, b) if c % 2 else (b, a))) for ind, pop, reg, l, a, b in geno for c in range(3)]
    many = [(9000 + i, "A", "R", 10 + l, 1, 2 if (i, l) != (2, 20) else 3) for i in (1, 2, 3) for l in range(1, 21)]
    data = Dataset(spark, geno=spark.createDataFrame(geno + many, "ind bigint, pop string, region string, locus int, a1 bigint, a2 bigint"))
    met, meetings = [], pairs.meetings
    monkeypatch.setattr(pairs, "meetings", lambda df: met.append(df.count()) or meetings(df))
    want, got = told(data.sql(QUERIES["near_clones"])), told(data.result("near_clones"))
    assert len(want) >= 60 and [r[:3] for r in got] == [r[:3] for r in want]
    assert all(g == pytest.approx(w, abs=2e-6) for g, w in zip(got, want, strict=True))
    assert met[0] <= len({(p, i) for i, p, *_ in geno}) / 3 + 3
