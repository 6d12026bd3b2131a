import pytest

from popspark.dataset import Dataset
from popspark.sources import readers, sheets


def read(spark, tmp_path, text, roles, **more):
    path = tmp_path / "sheet.csv"
    path.write_text(text)
    return sheets.cells(readers.delimited(spark, str(path)), roles, **more)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def found(sheet, kind):
    return {r["issue"]: (r["level"], r["n"], r["examples"]) for r in sheets.issues(sheet, kind).collect()}


def test_bands(spark, tmp_path):
    sheet = read(spark, tmp_path, "ID,Pop,Lat,Lon,P1,P1,\na,N,1.5,2,1,0,1\nb,N,95,2,0,2,\nb,,,,,,\n", {"id": 0, "pop": 1, "lat": 2, "lon": 3})
    assert rows(sheets.bands(sheet), "ind", "pop", "band", "x") == [(1, "N", "L3", 1), (1, "N", "P1_1", 1), (1, "N", "P1_2", 0), (2, "N", "P1_1", 0)]
    assert rows(sheets.places(sheet), "ind", "lat", "lon") == [(1, 1.5, 2.0)]
    assert found(sheet, "bands") == {
        "badBand": ("error", 1, ["row 3 P1_2 2"]),
        "emptyRow": ("warning", 1, ["row 4 b"]),
        "dupId": ("error", 2, ["row 3 b", "row 4 b"]),
        "noPop": ("warning", 1, ["row 4 b"]),
        "coordRange": ("error", 1, ["row 3 b"]),
    }
    # The relations go straight into the operators.
    assert {r["band"] for r in Dataset(spark, bands=sheets.bands(sheet)).result("band_classes").collect()} == {"P1_1", "P1_2", "L3"}


def test_genotypes_in_one_cell(spark, tmp_path):
    text = "Ind\tPop\tRegion\tA\tB\n" + "".join(f"i{k}\tP\tR\t{a}\t{b}\n" for k, (a, b) in enumerate([("180/184", "AG"), ("18O/184", "GG"), ("180184", "x"), ("180", "AA"), ("?", "-9")]))
    sheet = read(spark, tmp_path, text, {"id": 0, "pop": 1, "region": 2})
    assert rows(sheets.genotypes(sheet), "ind", "region", "locus", "a1", "a2") == [(1, "R", "A", "180", "184"), (1, "R", "B", "A", "G"), (2, "R", "B", "G", "G"), (3, "R", "A", "180", "184"), (4, "R", "B", "A", "A")]
    got = found(sheet, "genotypes")
    assert got["mixedCodes"] == ("error", 1, ["row 3 A 18O/184"]) and got["alleleCount"] == ("error", 1, ["row 5 A 180"]) and got["emptyRow"][1] == 1
    shape = sheets.cell_shapes(sheet).first()
    assert (shape["n"], shape["combined"], shape["letters"]) == pytest.approx((7, 2 / 7, 3 / 7))


def test_haploid_and_profiles(spark, tmp_path):
    sheet = read(spark, tmp_path, "ID;Pop;h1;h2;skip\na;N;4;0;z\nb;S;4/5;NULL;z\n", {"id": 0, "pop": 1}, ignored=(4,), missing_code="0")
    assert rows(sheets.haploid(sheet), "ind", "pop", "locus", "allele") == [(1, "N", "h1", "4"), (2, "S", "h1", "4/5")]
    assert found(sheet, "haploid") == {"twoAllelesHaploid": ("warning", 1, ["row 3 h1 4/5"]), "emptyLocus": ("warning", 1, ["h2"])}
    profiles = {r["name"]: r for r in sheets.column_profiles(sheet).collect()}
    assert (profiles["h1"]["numeric"], profiles["h1"]["text"], profiles["h1"]["kind"]) == (1, 1, "nominal")
    assert (profiles["h2"]["missing"], profiles["h2"]["binary"]) == (2, False)


def test_traits(spark, tmp_path):
    body = "".join(f"{k};N;{k},5;{k % 3};{'rg'[k % 2]};{k % 2}\n" for k in range(14))
    sheet = read(spark, tmp_path, "ID;Pop;length;teeth;colour;hair\n" + body + "z;N;long;;r;1\n", {"id": 0, "pop": 1})
    assert {r["name"]: r["kind"] for r in sheets.column_profiles(sheet).collect()} == {"length": "quantitative", "teeth": "discrete", "colour": "nominal", "hair": "binary"}
    got = {(r["ind"], r["trait"]): (r["v"], r["code"]) for r in sheets.traits(sheet).collect()}
    assert got[3, "length"] == (2.5, None) and got[2, "colour"] == (None, "g") and (15, "length") not in got and (15, "teeth") not in got
    assert found(sheet, "traits") == {"traitText": ("warning", 1, ["row 16 length long"])}


def test_sequences(spark, tmp_path):
    sheet = read(spark, tmp_path, "ID,Pop,g1,g2\na,N,ac gu,TT\nb,N,AC.T,\nc,S,AC,T!\n", {"id": 0, "pop": 1})
    seqs = sheets.sequences(sheet)
    assert rows(seqs, "ind", "seq") == [(1, "ACGTTT"), (2, "AC-T??"), (3, "AC??T!")]
    assert rows(sheets.sites(seqs).where("ind = 2"), "site", "base") == [(1, "A"), (2, "C"), (3, "-"), (4, "T"), (5, "?"), (6, "?")]
    got = found(sheet, "sequences")
    assert got["missingSeq"] == ("warning", 1, ["row 3 g2"]) and got["badBase"] == ("error", 1, ["row 4 g2 T!"])


def test_a_header_alone(spark, tmp_path):
    sheet = read(spark, tmp_path, "ID,Pop,A\n", {"id": 0, "pop": 1})
    assert sheets.bands(sheet).count() == sheets.sequences(sheet).count() == sheets.traits(sheet).count() == sheets.genotypes(sheet).count() == sheets.issues(sheet, "bands").count() == 0
