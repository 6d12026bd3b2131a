"""Sheets of each layout become data sets without given roles."""

import random

import pytest

from popspark.sources import layout, readers


def sheet(spark, tmp_path, text, name="sheet.csv"):
    path = tmp_path / name
    path.write_text(text)
    return readers.delimited(spark, str(path))


def table(*rows, sign=","):
    return "\n".join(sign.join(map(str, r)) for r in rows) + "\n"


def test_bands_with_labels_anywhere(spark, tmp_path):
    rnd = random.Random(1)
    body = [(f"p{i}", rnd.randint(0, 1), "north" if i < 4 else "south", rnd.randint(0, 1), 19 + i / 10, -99 - i / 10, rnd.randint(0, 1)) for i in range(8)]
    data, found = layout.dataset(sheet(spark, tmp_path, table(("Plant", "B1", "Population", "B2", "Latitude (°)", "Lon_W", "B3"), *body)))
    assert (found["kind"], found["orientation"], found["id"], found["pop"], found["lat"], found["lon"], found["missing_code"]) == ("dominant", "rows-are-individuals", 0, 2, 4, 5, "")
    got = {(r.ind, r.pop, r.band): r.x for r in data.relations["bands"].collect()}
    assert got == {(i + 1, b[2], n): b[k] for i, b in enumerate(body) for n, k in (("B1", 1), ("B2", 3), ("B3", 6))}
    assert {(r.ind, r.lat, r.lon) for r in data.relations["places"].collect()} == {(i + 1, b[4], b[5]) for i, b in enumerate(body)}
    assert data.result("band_classes").count() == 3


def test_band_matrix_with_loci_as_rows(spark, tmp_path):
    rnd = random.Random(2)
    races = ["Conico", "Chalqueno", "Bolita", "Tuxpeno"]
    body = [(f"primer{i // 3}", *(rnd.randint(0, 1) for _ in races)) for i in range(9)]
    rows = sheet(spark, tmp_path, table(("ISSR", *races), *body))
    (one,) = layout.orientations(rows).collect()
    assert (one.orientation, one.confidence) == ("rows-are-loci", "high")
    data, found = layout.dataset(rows)
    assert (found["kind"], found["id"], found["pop"]) == ("dominant", 0, None)
    got = {(r.ind, r.band): r.x for r in data.relations["bands"].collect()}
    names = [f"primer{i // 3}_{i % 3 + 1}" for i in range(9)]
    assert got == {(j + 1, names[i]): b[j + 1] for i, b in enumerate(body) for j in range(4)}


@pytest.mark.parametrize("head", [("A", "A", "B", "B"), ("A", "", "B", ""), ("A_1", "A_2", "B_1", "B_2"), ("A.a", "A.b", "B.a", "B.b")])
def test_two_columns_per_locus(spark, tmp_path, head):
    rnd = random.Random(3)
    body = [(f"i{k}", "PQ"[k % 2], *(rnd.choice((180, 182, 184)) for _ in range(3)), rnd.choice((200, 204))) for k in range(12)]
    body[4] = (*body[4][:2], 0, 182, 200, 204)  # half a genotype is missing
    data, found = layout.dataset(sheet(spark, tmp_path, table(("ID", "Pop", *head), *body, sign=";")))
    assert (found["kind"], found["cells"], found["missing_code"], found["id"], found["pop"]) == ("codominant", "columns", "0", 0, 1)
    got = {(r.ind, r.pop, r.locus): (r.a1, r.a2) for r in data.relations["geno"].collect()}
    want = {(k + 1, b[1], l): (str(b[2 + 2 * n]), str(b[3 + 2 * n])) for k, b in enumerate(body) for n, l in enumerate("AB")}
    del want[5, body[4][1], "A"]
    assert got == want


def test_unnamed_labels_combined_genotypes(spark, tmp_path):
    rnd = random.Random(4)
    body = [(f"x{k}", ("alto", "bajo")[k % 2], *(f"{rnd.choice((180, 182))}/{rnd.choice((182, 184))}" for _ in range(4))) for k in range(10)]
    data, found = layout.dataset(sheet(spark, tmp_path, table(("c1", "c2", "L1", "L2", "L3", "L4"), *body)))
    assert (found["kind"], found["cells"], found["id"], found["pop"]) == ("codominant", "combined", 0, 1)
    assert data.relations["geno"].count() == 40 and {r.pop for r in data.relations["geno"].collect()} == {"alto", "bajo"}


def test_sequences_traits_and_haploid(spark, tmp_path):
    rnd = random.Random(5)
    seqs = [(f"s{k}", "P" if k < 3 else "Q", "".join(rnd.choice("ACGT") for _ in range(24))) for k in range(6)]
    data, found = layout.dataset(sheet(spark, tmp_path, table(("Sample", "Site", "trnL"), *seqs), "a.csv"))
    assert (found["kind"], found["id"], found["pop"]) == ("sequence", 0, 1) and data.relations["sites"].count() == 6 * 24
    traits = [(f"t{k}", "PQ"[k % 2], 10 + 1.37 * k, 100 - 2.11 * k, 0.5 + k * k) for k in range(20)]
    data, found = layout.dataset(sheet(spark, tmp_path, table(("Plant", "Race", "Longitud_mazorca", "width", "height"), *traits), "b.csv"))
    assert (found["kind"], found["pop"], found["lon"]) == ("morph", 1, None) and data.relations["traits"].count() == 60
    codes = [(f"h{k}", "PQ"[k % 2], *(rnd.choice(("wild", "crop", "weed")) for _ in range(4))) for k in range(12)]
    data, found = layout.dataset(sheet(spark, tmp_path, table(("name", "pop", "x1", "x2", "x3", "x4"), *codes), "c.csv"))
    assert found["kind"] == "haploid" and data.relations["hap"].count() == 48


def test_header_pairs(spark):
    heads = {"a": ["ID", "Pop", "A", "A", "B", "B"], "b": ["A", "A", "A", "B"], "c": ["x", "y", "z"], "d": ["ID", "La", "Lb", "M1", "M2"], "e": ["one"]}
    rows = spark.createDataFrame([(f, 0, h) for f, h in heads.items()] + [(f, 1, ["1"] * len(h)) for f, h in heads.items()], "file string, row int, cells array<string>")
    got = {r.file: (r.pairs, r.singles, r.offset, r.over_repeated, r.looks_codominant) for r in layout.header_pairs(rows).collect()}
    assert got == {"a": (2, 1, 0, False, True), "b": (1, 1, 0, True, False), "c": (0, 1, 0, False, False), "d": (2, 0, 1, False, True), "e": (0, 0, 0, False, False)}


def test_transposed_and_empty(spark):
    rows = spark.createDataFrame([("f", 0, ["k", "a", "b"]), ("f", 1, ["x", "1"]), ("f", 2, ["y", None, "2", " "]), ("g", 0, ["only"])], "file string, row int, cells array<string>")
    got = {(r.file, r.row): r.cells for r in layout.transposed(rows, "Unit").collect()}
    assert got == {("f", 0): ["Unit", "x", "y"], ("f", 1): ["a", "1", None], ("f", 2): ["b", None, "2"], ("g", 0): ["Unit"]}
    with pytest.raises(ValueError, match="no sheet"):
        layout.dataset(rows.where("file = 'g'"))


def test_files_of_one_layout(spark, tmp_path):
    for name, who in (("1.csv", "a"), ("2.csv", "b")):
        (tmp_path / name).write_text(table(("ID", "Pop", "ear", "leaf"), *((f"{who}{k}", "PQ"[k % 2], 1.5 * k, 40 - k) for k in range(20))))
    data, _ = layout.dataset(readers.delimited(spark, str(tmp_path)))
    assert len({(r.ind, r.trait) for r in data.relations["traits"].collect()}) == 80
