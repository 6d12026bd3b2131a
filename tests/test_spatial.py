"""Correlograms against all pairs of individuals."""

import itertools

import numpy as np
import pytest

from popspark.dataset import QUERIES, Dataset
from popspark.operators import pairs, ranked, spatial

GENO = "ind bigint, pop string, region string, locus string, a1 bigint, a2 bigint"


def field(n=40, seed=1):
    """Individuals on a plane of degrees whose genotypes drift from west to east; some missing, one unmapped, one small population."""
    g = np.random.default_rng(seed)
    rows, places = [], []
    for i in range(n):
        lat, lon = float(g.uniform(0, 1)), float(g.uniform(0, 4))
        places.append((i, "AB"[i % 2], lat, lon))
        for l in range(5):
            if g.random() < 0.9:
                rows.append((i, "AB"[i % 2], "R", f"L{l}", *(int(g.random() < 0.1 + lon / 5) + int(g.integers(0, 2)) for _ in range(2))))
    rows += [(900, "A", "R", "L0", 0, 1), (901, "C", "R", "L0", 0, 1)]
    return rows, [*places, (900, "A", None, 1.0), (901, "C", 1.0, 1.0)]


def kinship(rows, inds):
    """Loiselle's kinship, locus by locus and allele by allele."""
    of = {(r[0], r[3]): r[4:] for r in rows if r[0] in inds}
    out = {}
    loci = sorted({l for _, l in of})
    ref = {}
    for l in loci:
        copies = [a for (i, m), g in of.items() if m == l for a in g]
        ref[l] = ({a: copies.count(a) / len(copies) for a in copies}, len(copies))
    for i, j in itertools.combinations(sorted(inds), 2):
        num = den = 0.0
        for l in loci:
            if (i, l) in of and (j, l) in of:
                for a, p in ref[l][0].items():
                    num += (of[i, l].count(a) / 2 - p) * (of[j, l].count(a) / 2 - p) + p * (1 - p) / (ref[l][1] - 1)
                    den += p * (1 - p)
        out[i, j] = num / den if den else np.nan
    return out


@pytest.mark.parametrize("tile", [512, 7])
def test_kinship_by_distance(spark, monkeypatch, tile):
    monkeypatch.setattr(spatial, "TILE", tile)
    rows, places = field()
    where = {p[0]: p[2:] for p in places if p[2] is not None}
    pairs, known, g = [], {}, np.random.default_rng(9)
    for pop in "AB":
        k = kinship(rows, {p[0] for p in places if p[1] == pop and p[2] is not None})
        known |= k
        for (i, j), v in k.items():
            km = spatial.kilometres(*(np.array([where[i][c], where[j][c]]) for c in (0, 1)), np.array([0]), np.array([1]))[0, 0]
            pairs.append((km, v, i, j))
    pairs.sort()
    n = len(pairs)
    classes = min(10, n // 30)
    per = -(-n // classes)
    table, line = spatial.correlogram(spatial.genotype_scores(spark.createDataFrame(rows, GENO)), spark.createDataFrame(places, "ind bigint, pop string, lat double, lon double"), 99)
    got = {r["class"]: r for r in table.collect()}
    assert len(got) == classes
    for c in range(classes):
        own = pairs[c * per : (c + 1) * per]
        assert (got[c].n, got[c].km, got[c].value) == pytest.approx((len(own), np.mean([k for k, *_ in own]), np.mean([v for _, v, *_ in own])), abs=1e-9)
        assert got[c].low95 <= got[c].high95
    x, y = np.log([k for k, *_ in pairs]), np.array([v for _, v, *_ in pairs])
    slope = np.polyfit(x, y, 1)[0]
    one = line.first()
    assert (one.slope, one.n) == pytest.approx((slope, n), abs=1e-9) and one.p_slope == pytest.approx(0.01)
    drawn = []
    for _ in range(600):
        to = {}
        for pop in "AB":
            ids = sorted(p[0] for p in places if p[1] == pop and p[2] is not None)
            to |= dict(zip(ids, g.permutation(ids).tolist()))
        drawn.append(np.mean([known[min(to[i], to[j]), max(to[i], to[j])] for _, _, i, j in pairs[:per]]))
    assert got[0].p == pytest.approx(np.mean(np.array(drawn) >= got[0].value), abs=0.07)
    assert (got[0].low95, got[0].high95) == pytest.approx(np.quantile(drawn, (0.025, 0.975)), abs=0.03)
    assert one.sp == pytest.approx(-slope / (1 - got[0].value))


def test_smouse_peakall(spark):
    g = np.random.default_rng(4)
    at = g.uniform(0, 2, (24, 2))
    x = (g.random((24, 8)) < 0.2 + 0.3 * at[:, :1]).astype(int)
    bands = spark.createDataFrame([(i, "P", f"b{k}", int(x[i, k])) for i in range(24) for k in range(8)], "ind bigint, pop string, band string, x int")
    places = spark.createDataFrame([(i, "P", float(a), float(b)) for i, (a, b) in enumerate(at)], "ind bigint, pop string, lat double, lon double")
    table, line = spatial.correlogram(spatial.band_scores(bands), places, 49, kinship=False)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    row = (-0.5 * d).mean(axis=1)
    c = -0.5 * d - row[:, None] - row[None] + row.mean()
    pairs = sorted((spatial.kilometres(at[:, 0], at[:, 1], np.array([i]), np.array([j]))[0, 0], i, j) for i, j in itertools.combinations(range(24), 2))
    classes = min(10, len(pairs) // 30)
    per = -(-len(pairs) // classes)
    got = {r["class"]: r.value for r in table.collect()}
    for k in range(classes):
        own = pairs[k * per : (k + 1) * per]
        assert got[k] == pytest.approx(sum(2 * c[i, j] for _, i, j in own) / sum(c[i, i] + c[j, j] for _, i, j in own), abs=1e-9)
    assert line.count() == 0


def test_few_pairs(spark):
    rows, places = field(9)
    table, line = spatial.correlogram(spatial.genotype_scores(spark.createDataFrame(rows, GENO)), spark.createDataFrame(places, "ind bigint, pop string, lat double, lon double"), 9)
    assert table.count() == 0 and line.count() == 0


@pytest.mark.parametrize("places_of", ["apart", "tied", "few"])
def test_ranked_pairs_equal_the_sql(spark, monkeypatch, places_of):
    """Blocks, ranges and distances that many pairs share; no step of the Spark form gives a row per pair."""
    monkeypatch.setattr(pairs, "SMALL", 9)
    monkeypatch.setattr(ranked, "WIDTH", 1 << 24)
    rows, places = field(9 if places_of == "few" else 40)
    if places_of == "tied":
        places = [(i, p, lat and float(round(lat)), lon and float(round(lon))) for i, p, lat, lon in places]
    data = Dataset(spark, geno=spark.createDataFrame(rows, GENO), places=spark.createDataFrame(places, "ind bigint, pop string, lat double, lon double"))
    for name in ("correlogram", "kinship_slope"):
        want, got = data.sql(QUERIES[name]), data.result(name)
        assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        want, got = (sorted(tuple(r) for r in x.collect()) for x in (want, got))
        assert len(got) == len(want) and all(g == pytest.approx(w, abs=2e-6) for g, w in zip(got, want, strict=True))
    made = []
    monkeypatch.setattr(ranked, "kept", lambda df: made.append(df) or df)
    ranked.by_class(data.sql("SELECT * FROM mapped_rows"))
    n = data.result("kinship_slope").first().n
    assert places_of != "apart" or made[-1].where("mm IS NOT NULL").count() < n / 10


@pytest.mark.parametrize("rounded", [False, True])
def test_copies_are_compared_once(spark, monkeypatch, rounded):
    """Individuals of one place and genotype are one row with a weight; pairs at limits are told apart by ids all the same."""
    rows, places = field(24)
    if rounded:
        places = [(i, p, lat and float(round(lat)), lon and float(round(lon))) for i, p, lat, lon in places]
    # Copies with ids between and beyond, of alleles in either order.
    rows = [(4 * i + c, p, r, l, *((a, b) if c % 2 else (b, a))) for i, p, r, l, a, b in rows for c in range(4)]
    places = [(4 * i + c, *rest) for i, *rest in places for c in range(4)]
    data = Dataset(spark, geno=spark.createDataFrame(rows, GENO), places=spark.createDataFrame(places, "ind bigint, pop string, lat double, lon double"))
    for name in ("correlogram", "kinship_slope"):
        want, got = (sorted(tuple(r) for r in x.collect()) for x in (data.sql(QUERIES[name]), data.result(name)))
        assert len(got) == len(want) and all(g == pytest.approx(w, abs=2e-6) for g, w in zip(got, want, strict=True))
    met, meetings = [], ranked.meetings
    monkeypatch.setattr(ranked, "meetings", lambda df: met.append(df.count()) or meetings(df))
    ranked.by_class(data.sql("SELECT * FROM mapped_rows"))
    assert met == [24]
