"""From a sheet of individuals to the relations of ``popspark.dataset``, by kind of marker.

A sheet is what ``readers.delimited`` gives: file, row (0 the header), cells. ``cells`` turns it
into one row per individual and data column; the functions below it read these as bands, haploid
loci, whole genotypes, traits or sequences. The number of an individual (``ind``) is its row, counted on from file to file, as ids
may repeat. A cell that can't be read counts as missing and is listed by ``issues``.

Short rows have missing cells at their end, a blank column name gets a number, empty sheets give
empty relations. Missing population names stay null: such individuals are in no population.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popspark.sources.readers import missing, split_genotype

LABELS = ("id", "pop", "region", "lat", "lon")
NUMBER = r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?$"
DECIMAL_COMMA = r"^-?\d+,\d+$"
# IUPAC codes, gaps and unknown bases; and the shapes of cells that hold a whole genotype or sequence.
BASES = "ACGTUNRYSWKMBDHV?.-"
SEQUENCE = r"(?i)^[ACGTUNRYSWKMBDHV?\-.]{20,}$"
COMBINED = r"^[A-Za-z0-9.]+(\s*[/|:]\s*[A-Za-z0-9.]+)+$|^\d{2,3}-\d{2,3}$"
TWO_LETTERS = r"(?i)^[ACGT]{2}$"
# The kinds of issues, and which of them are errors.
ERRORS = ("badBand", "alleleCount", "mixedCodes", "dupId", "coordRange", "badBase")
EXAMPLES = 6


def number(cell: Column) -> Column:
    """The cell as a number, a decimal comma allowed; null for text."""
    return F.when(F.trim(cell).rlike(NUMBER), F.translate(F.trim(cell), ",", ".").try_cast("double"))


def column_names(rows: DataFrame, labels: list[int], fallback: str = "L") -> DataFrame:
    """file, names: an array by column. Names that repeat among data columns are numbered from 1, blank ones by their place."""
    each = rows.where("row = 0").select("file", F.posexplode("cells").alias("col", "raw"))
    data = ~F.col("col").isin(labels) if labels else F.lit(True)
    each = each.select("file", "col", F.trim("raw").alias("name"), data.alias("data"))
    by_name, in_file = Window.partitionBy("file", "data", "name"), Window.partitionBy("file", "data").orderBy("col")
    each = each.select("file", "col", "name", F.count("*").over(by_name).alias("times"), F.row_number().over(by_name.orderBy("col")).alias("nth"), F.row_number().over(in_file).alias("place"))
    name = F.when(F.col("name") == "", F.concat(F.lit(fallback), "place")).when(F.col("times") > 1, F.concat_ws("_", "name", "nth")).otherwise(F.col("name"))
    return each.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", name.alias("name")))), lambda x: x["name"]).alias("names"))


def cells(rows: DataFrame, roles: Mapping[str, int], ignored: tuple[int, ...] = (), missing_code: str | None = None, fallback: str = "L") -> DataFrame:
    """file, row, ind, id, pop, region, lat, lon, col, name, v: each data cell, null where it is missing. ``roles`` gives the columns of LABELS."""
    labels = [*roles.values(), *ignored]
    names = column_names(rows, labels, fallback)

    def label(role: str) -> Column:
        cell = F.get("cells", F.lit(roles[role])) if role in roles else F.lit(None).cast("string")
        return F.when(~missing(cell, ""), F.trim(cell))

    # Individuals of a file are numbered after those of the files before it; the window has a row per file.
    last = rows.groupBy("file").agg(F.max("row").alias("last"))
    before = last.select("file", (F.sum("last").over(Window.orderBy("file")) - F.col("last")).alias("before"))
    body = rows.where("row > 0").join(names, "file").join(before, "file")
    wide = body.select("file", "row", (F.col("row") + F.col("before")).cast(rows.schema["row"].dataType).alias("ind"), *[(number(label(c)) if c in ("lat", "lon") else label(c)).alias(c) for c in LABELS], "cells", "names")
    # All columns of the header, so that a short row has its missing cells too.
    each = F.expr("transform(sequence(0, greatest(size(names), 1) - 1), i -> struct(i AS col, get(names, i) AS name, trim(get(cells, i)) AS v))")
    long = wide.select("file", "row", "ind", *LABELS, F.inline(each)).where("name IS NOT NULL")
    long = long.where(~F.col("col").isin(labels)) if labels else long
    return long.withColumn("v", F.when(~missing(F.col("v"), missing_code or ""), F.col("v")))


def column_profiles(sheet: DataFrame) -> DataFrame:
    """file, col, name, n, numeric, text, missing, distinct, binary, kind (binary, quantitative, discrete or nominal) of ``cells``."""
    there = F.col("v").isNotNull()
    numeric = F.col("v").rlike(NUMBER) & (~F.col("v").contains(",") | F.col("v").rlike(DECIMAL_COMMA))
    count = lambda ok: F.count(F.when(ok, 1))
    found = sheet.groupBy("file", "col", "name").agg(
        F.count("*").alias("n"), count(there & numeric).alias("numeric"), count(there & ~numeric).alias("text"), count(~there).alias("missing"), F.countDistinct("v").alias("distinct"), (count(there & ~F.col("v").isin("0", "1")) == 0).alias("plain")
    )
    binary = F.col("plain") & (F.col("n") > F.col("missing"))
    more = F.col("numeric") > F.col("text")
    kind = F.when(binary, "binary").when(more & (F.col("distinct") > 12), "quantitative").when(more, "discrete").otherwise("nominal")
    return found.select("file", "col", "name", "n", "numeric", "text", "missing", "distinct", binary.alias("binary"), kind.alias("kind"))


def cell_shapes(sheet: DataFrame) -> DataFrame:
    """file, n, and the shares of cells that hold a sequence, a whole genotype with a sign, or two bases."""
    v = F.col("v")
    shape = F.when(v.rlike(SEQUENCE), "sequence").when(v.rlike(COMBINED), "combined").when(v.rlike(TWO_LETTERS), "letters")
    counted = sheet.where(v.isNotNull()).groupBy("file").agg(F.count("*").alias("n"), *[F.count(F.when(shape == s, 1)).alias(s) for s in ("sequence", "combined", "letters")])
    return counted.select("file", "n", *[(F.col(s) / F.col("n")).alias(s) for s in ("sequence", "combined", "letters")])


def bands(sheet: DataFrame) -> DataFrame:
    """ind, pop, band, x of dominant markers: 0 or 1."""
    return sheet.where(F.col("v").isin("0", "1")).select("ind", "pop", F.col("name").alias("band"), F.col("v").cast("int").alias("x"))


def haploid(sheet: DataFrame) -> DataFrame:
    """ind, pop, locus, allele."""
    return sheet.where("v IS NOT NULL").select("ind", "pop", F.col("name").alias("locus"), F.col("v").alias("allele"))


def genotypes(sheet: DataFrame) -> DataFrame:
    """ind, pop, region, locus, a1, a2 of diploid genotypes written in one cell; typing errors among sizes (``mixed_codes``) are left out."""
    both = split_genotype(F.col("v"))
    read = sheet.select("ind", "pop", "region", F.col("name").alias("locus"), both.alias("g")).where("g IS NOT NULL")
    read = read.select("ind", "pop", "region", "locus", F.col("g")[0].alias("a1"), F.col("g")[1].alias("a2"))
    odd = mixed_codes(read).select("locus", F.col("allele").alias("odd"))
    for side in ("a1", "a2"):
        read = read.join(odd.withColumnRenamed("odd", side), ["locus", side], "left_anti")
    return read.select("ind", "pop", "region", "locus", "a1", "a2")


def mixed_codes(geno: DataFrame) -> DataFrame:
    """locus, allele: one or two text codes of a locus whose other alleles are numbers."""
    alleles = geno.select("locus", F.explode(F.array("a1", "a2")).alias("allele")).distinct()
    text = ~F.col("allele").rlike(r"^-?\d+(\.\d+)?$")
    per = alleles.groupBy("locus").agg(F.count(F.when(text, 1)).alias("odd"), F.count("*").alias("k")).where("odd BETWEEN 1 AND 2 AND odd < k")
    return alleles.where(text).join(per.select("locus"), "locus", "left_semi")


def traits(sheet: DataFrame) -> DataFrame:
    """ind, pop, trait, v (number), code (text): a trait with more numbers than texts keeps its numbers, another its codes."""
    kinds = column_profiles(sheet).select("file", "col", "kind")
    each = sheet.where("v IS NOT NULL").join(kinds, ["file", "col"])
    value = F.when(F.col("kind") != "nominal", number(F.col("v")))
    code = F.when(F.col("kind") == "nominal", F.col("v"))
    return each.select("ind", "pop", F.col("name").alias("trait"), value.alias("v"), code.alias("code")).where("v IS NOT NULL OR code IS NOT NULL")


def sequences(sheet: DataFrame) -> DataFrame:
    """ind, pop, seq: gene regions of all columns in their order, each filled up with ? to its longest; U is T, a dot a gap."""
    bare = F.upper(F.regexp_replace(F.coalesce("v", F.lit("")), r"\s+", ""))
    each = sheet.select("file", "ind", "pop", "col", F.translate(bare, "U.", "T-").alias("s"))
    longest = each.groupBy("file", "col").agg(F.max(F.length("s")).alias("most"))
    filled = each.join(longest, ["file", "col"]).select("file", "ind", "pop", F.struct("col", F.expr("rpad(s, most, '?')").alias("s")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["s"]), "")
    return filled.groupBy("file", "ind", "pop").agg(joined.alias("seq")).drop("file")


def sites(seqs: DataFrame) -> DataFrame:
    """ind, pop, site (from 1), base."""
    return seqs.where("seq <> ''").select("ind", "pop", F.posexplode(F.split("seq", "")).alias("at", "base")).where("base <> ''").select("ind", "pop", (F.col("at") + 1).alias("site"), "base")


def places(sheet: DataFrame) -> DataFrame:
    """ind, pop, lat, lon of individuals with coordinates in range."""
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return sheet.where(ok).select("ind", "pop", "lat", "lon").distinct()


def issues(sheet: DataFrame, kind: str) -> DataFrame:
    """issue, level, n, examples (the first EXAMPLES, by row and column) of ``cells`` read as ``kind``: bands, haploid, genotypes, traits or sequences."""
    v, there = F.col("v"), F.col("v").isNotNull()
    cell = F.concat_ws(" ", F.lit("row"), F.col("row") + 1, "name", v)
    person = F.concat_ws(" ", F.lit("row"), F.col("row") + 1, "id")
    wrong = {
        "bands": {"badBand": there & ~v.isin("0", "1")},
        "haploid": {"twoAllelesHaploid": v.rlike("[/|]")},
        "genotypes": {"alleleCount": there & split_genotype(v).isNull()},
        "traits": {},
        "sequences": {"missingSeq": ~there, "badBase": F.translate(F.upper(F.regexp_replace(v, r"\s+", "")), BASES, "") != ""},
    }[kind]
    found = [sheet.where(test).select(F.lit(name).alias("issue"), "ind", "col", cell.alias("example")) for name, test in wrong.items()]
    if kind == "traits":
        kinds = column_profiles(sheet).where("kind <> 'nominal'").select("file", "col")
        text = sheet.where(there & number(v).isNull()).join(kinds, ["file", "col"], "left_semi")
        found.append(text.select(F.lit("traitText").alias("issue"), "ind", "col", cell.alias("example")))
    if kind == "genotypes":
        split = sheet.select("*", F.explode(split_genotype(v)).alias("allele"))
        odd = mixed_codes(sheet.select(F.col("name").alias("locus"), split_genotype(v).alias("g")).where("g IS NOT NULL").select("locus", F.col("g")[0].alias("a1"), F.col("g")[1].alias("a2")))
        found.append(split.join(odd.select(F.col("locus").alias("name"), "allele"), ["name", "allele"], "left_semi").select(F.lit("mixedCodes").alias("issue"), "ind", "col", cell.alias("example")).distinct())
    people = sheet.groupBy("file", "row", "ind", "id", "pop", "lat", "lon").agg(F.count("v").alias("scored"))
    again = people.where("id IS NOT NULL").withColumn("times", F.count("*").over(Window.partitionBy("file", "id"))).where("times > 1")
    outside = F.coalesce(~F.col("lat").between(-90, 90), F.lit(False)) | F.coalesce(~F.col("lon").between(-180, 180), F.lit(False))
    of_people = {"emptyRow": people.where("scored = 0"), "dupId": again, "noPop": people.where("pop IS NULL"), "coordRange": people.where(outside)}
    found += [rows.select(F.lit(name).alias("issue"), "ind", F.lit(-1).alias("col"), person.alias("example")) for name, rows in of_people.items()]
    empty = sheet.groupBy("file", "col", "name").agg(F.count("v").alias("scored")).where("scored = 0")
    found.append(empty.select(F.lit("emptyLocus").alias("issue"), F.lit(0).cast("int").alias("ind"), "col", F.col("name").alias("example")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    first = every.withColumn("k", F.row_number().over(Window.partitionBy("issue").orderBy("ind", "col"))).where(F.col("k") <= EXAMPLES)
    shown = first.groupBy("issue").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "example"))), lambda x: x["example"]).alias("examples"))
    counted = every.groupBy("issue").agg(F.count("*").alias("n"))
    return counted.join(shown, "issue").select("issue", F.when(F.col("issue").isin(*ERRORS), "error").otherwise("warning").alias("level"), "n", "examples")
