"""Readers of the field's text formats, as DataFrames of genotypes, haplotypes or sequences.

Files are read by Spark (one row per file, then one per line with its number, so the
order of lines is known); everything after is DataFrame work and covers many files at
once. Unreadable genotypes become null; they never stop a read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Spellings of a missing cell.
MISSING = ("", "-9", "-99", "-999", "na", "n/a", "nan", "?", ".", "..", "null", "missing", "x")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (from 0), line; a byte-order mark and carriage returns are taken off."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("t"))
    return whole.select("file", F.posexplode(F.split("t", "\r\n|\n|\r")).alias("n", "line"))


def format_of(text: Column) -> Column:
    """Which format a file's text is in, by its first signs; the order of the tests matters."""
    return (
        F.when(text.rlike(r"^\s*>"), "fasta")
        .when(text.rlike(r"^\s*##fileformat=VCF"), "vcf")
        .when(text.rlike(r"(?is)\[profile\].*samplename"), "arp")
        .when(text.rlike(r"(?im)^\s*pop\s*$") & text.contains(","), "gen")
        .otherwise("table")
    )


def missing(cell: Column, code: str | None = None) -> Column:
    low = F.lower(F.trim(cell))
    gone = cell.isNull() | low.isin(*MISSING)
    return gone | (low == code.lower()) if code else gone


def delimiter(text: Column) -> Column:
    """The commonest of comma, semicolon and tab in the first 20 lines; ties go to the earlier one."""
    head = F.array_join(F.slice(F.split(F.substring(text, 1, 5000), "\n"), 1, 20), "\n")
    count = lambda c: F.length(head) - F.length(F.replace(head, F.lit(c), F.lit("")))
    comma, semi, tab = count(","), count(";"), count("\t")
    return F.when((comma >= semi) & (comma >= tab), ",").when(semi >= tab, ";").otherwise("\t")


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """file, row (from 0, blank lines left out), cells: quoted cells may hold the delimiter and doubled quotes."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("t"))
    rows = whole.select("file", delimiter(F.col("t")).alias("d"), F.posexplode(F.split("t", "\r\n|\n|\r")).alias("n", "line")).where(F.trim("line") != "")
    cell = F.expr("""regexp_extract_all(concat(d, line), concat('[', d, ']((?:"(?:[^"]|"")*")|[^', d, ']*)'), 1)""")
    plain = F.transform(cell, lambda c: F.trim(F.when(c.rlike('^".*"$'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)))
    return rows.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1).alias("row"), plain.alias("cells"))


def genotype_table(spark: SparkSession, path: str, id_col: int = 0, pop_col: int = 1, first: int = 2, missing_code: str = "0") -> DataFrame:
    """ind_ix, ind, pop, locus, a1, a2 of a codominant sheet in which two neighbouring columns make a locus.

    A half-scored or missing genotype has both alleles null.
    """
    rows = delimited(spark, path)
    header = rows.where("row = 0").select("file", F.col("cells").alias("h"))
    body = rows.where("row > 0").join(header, "file")
    pairs = F.expr(f"transform(sequence({first}, size(h) - 2, 2), i -> struct(h[i] AS locus, get(cells, i) AS a1, get(cells, i + 1) AS a2))")
    each = body.select("file", F.col("row").alias("ind_ix"), F.col("cells")[id_col].alias("ind"), F.col("cells")[pop_col].alias("pop"), F.inline(pairs))
    ok = ~missing(F.col("a1"), missing_code) & ~missing(F.col("a2"), missing_code)
    return each.select("ind_ix", "ind", "pop", "locus", F.when(ok, F.col("a1")).alias("a1"), F.when(ok, F.col("a2")).alias("a2"))


def split_genotype(cell: Column) -> Column:
    """The two codes of a combined cell (182/186, A|G, AG, 180184, 180-184), or null."""
    c = F.trim(cell)
    return (
        F.when(c.rlike(r"^[^/|:;, ]+[/|:;, ][^/|:;, ]+$"), F.split(c, "[/|:;, ]"))
        .when(c.rlike(r"^\d{2,3}-\d{2,3}$"), F.split(c, "-"))
        .when(c.rlike(r"^[ACGTNacgtn]{2}$"), F.array(F.upper(F.substring(c, 1, 1)), F.upper(F.substring(c, 2, 1))))
        .when(c.rlike(r"^(\d{4}|\d{6})$"), F.transform(F.array(F.lit(1), F.lit(2)), lambda i: F.regexp_replace(F.substring(c, (i - 1) * (F.length(c) / 2).cast("int") + 1, (F.length(c) / 2).cast("int")), "^0+(?=.)", "")))
    )


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """file, ind_ix, ind, locus, a1, a2: the genotypes of VCF files. The first ALT counts; any other code is missing."""
    rows = lines(spark, path).where(~F.col("line").startswith("##") & (F.trim("line") != "")).select("file", F.split("line", "\t").alias("c"))
    names = rows.where(F.col("c")[0] == "#CHROM").select("file", F.slice("c", 10, 1_000_000).alias("names"))
    sites = rows.where(F.col("c")[0] != "#CHROM").join(names, "file")
    locus = F.when(F.col("c")[2].isin(".", ""), F.concat_ws("_", F.col("c")[0], F.col("c")[1])).otherwise(F.col("c")[2])
    gt = F.greatest(F.array_position(F.split(F.col("c")[8], ":"), "GT"), F.lit(1)).cast("int")
    each = sites.select("file", locus.alias("locus"), F.col("c")[3].alias("ref"), F.split(F.col("c")[4], ",")[0].alias("alt"), gt.alias("gt"), "names", F.posexplode(F.slice("c", 10, 1_000_000)).alias("ind_ix", "cell"))
    codes = each.select("file", "ind_ix", F.expr("get(names, ind_ix)").alias("ind"), "locus", "ref", "alt", F.split(F.expr("get(split(cell, ':'), gt - 1)"), r"[/|]").alias("g"))
    allele = lambda i: F.when(F.expr(f"get(g, {i})") == "0", F.col("ref")).when(F.expr(f"get(g, {i})") == "1", F.col("alt"))
    two = codes.select("file", "ind_ix", "ind", "locus", allele(0).alias("x"), allele(1).alias("y"))
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    return two.select("file", "ind_ix", "ind", "locus", F.when(ok, F.col("x")).alias("a1"), F.when(ok, F.col("y")).alias("a2"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, ind_ix, ind, pop, region, seq: headers ``id | pop | region``, bodies joined, upper case, U read as T."""
    rows = lines(spark, path).where(F.trim("line") != "")
    w = Window.partitionBy("file").orderBy("n")
    rows = rows.withColumn("ind_ix", F.sum(F.col("line").startswith(">").cast("int")).over(w) - 1).where("ind_ix >= 0")
    parts = rows.groupBy("file", "ind_ix").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"))
    head = F.split(F.expr("substr(ls[0].line, 2)"), r"\s*\|\s*|\s{2,}")
    body = F.expr("translate(upper(array_join(transform(slice(ls, 2, size(ls)), x -> trim(x.line)), '')), 'U ', 'T')")
    got = parts.select("file", "ind_ix", head.alias("h"), body.alias("seq"))
    return got.select("file", "ind_ix", F.trim(F.col("h")[0]).alias("ind"), F.expr("trim(get(h, 1))").alias("pop"), F.expr("trim(get(h, 2))").alias("region"), "seq")


def genepop(spark: SparkSession, path: str) -> DataFrame:
    """file, ind_ix, ind, pop, locus, a1, a2 of files with a title, locus names, and POP blocks."""
    rows = lines(spark, path).where((F.trim("line") != "") & (F.col("n") > 0))
    w = Window.partitionBy("file").orderBy("n")
    rows = rows.withColumn("block", F.sum(F.trim("line").rlike("(?i)^pop$").cast("int")).over(w))
    names = rows.where("block = 0").groupBy("file").agg(F.expr("flatten(transform(array_sort(collect_list(struct(n, line))), x -> transform(split(x.line, ','), y -> trim(y))))").alias("names"))
    data = rows.where((F.col("block") > 0) & F.col("line").contains(",")).join(names, "file")
    data = data.select("file", (F.row_number().over(w) - 1).alias("ind_ix"), F.concat(F.lit("Pop"), "block").alias("pop"), F.trim(F.substring_index("line", ",", 1)).alias("ind"), "names", F.split(F.trim(F.regexp_replace("line", "^[^,]*,", "")), r"\s+").alias("codes"))
    each = data.select("file", "ind_ix", "ind", "pop", "names", F.posexplode("codes").alias("k", "code")).withColumn("locus", F.expr("get(names, k)"))
    one = each.select("file", "ind_ix", "ind", "pop", "locus", "code", F.expr("substr(code, 1, CASE WHEN length(code) >= 6 THEN 3 ELSE 2 END)").alias("x"), F.expr("substr(code, CASE WHEN length(code) >= 6 THEN 4 ELSE 3 END)").alias("y"))
    number = lambda c: F.expr(f"nullif(try_cast({c} AS BIGINT), 0)")
    single = F.length("code") <= 3
    got = one.select("file", "ind_ix", "ind", "pop", "locus", F.when(single, number("code")).otherwise(number("x")).alias("a1"), F.when(single, number("code")).otherwise(number("y")).alias("a2"))
    ok = F.col("a1").isNotNull() & F.col("a2").isNotNull()
    return got.select("file", "ind_ix", "ind", "pop", "locus", F.when(ok, F.col("a1")).alias("a1"), F.when(ok, F.col("a2")).alias("a2"))


def structure(spark: SparkSession, path: str, labels: int = 2) -> DataFrame:
    """file, ind_ix, ind, pop, locus, a1, a2 of two-row files; an optional first line names the loci. Only -9 is missing."""
    rows = lines(spark, path).where(F.trim("line") != "").select("file", "n", F.split(F.trim("line"), r"\s+").alias("c"))
    w = Window.partitionBy("file").orderBy("n")
    first = rows.withColumn("k", F.row_number().over(w))
    named = F.exists("c", lambda x: ~x.rlike(r"^-?\d+$")) & (F.col("k") == 1)
    widths = rows.groupBy("file").agg(F.max(F.size("c")).alias("width"))
    first = first.join(widths, "file").withColumn("is_names", named & (F.size("c") < F.col("width")))
    names = first.where("is_names").select("file", F.col("c").alias("names"))
    data = first.where("NOT is_names").select("file", "n", "c").join(names, "file", "left").withColumn("k", F.row_number().over(w) - 1)
    data = data.select("file", F.floor(F.col("k") / 2).cast("int").alias("ind_ix"), (F.col("k") % 2).alias("side"), F.col("c")[0].alias("ind"), (F.col("c")[1] if labels > 1 else F.lit(None).cast("string")).alias("pop"), "names", F.posexplode(F.slice("c", labels + 1, 1_000_000)).alias("l", "allele"))
    locus = F.coalesce(F.expr("get(names, l)"), F.concat(F.lit("L"), F.col("l") + 1))
    each = data.groupBy("file", "ind_ix", locus.alias("locus")).agg(F.first("ind").alias("ind"), F.first("pop").alias("pop"), F.max(F.when(F.col("side") == 0, F.col("allele"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("allele"))).alias("y"))
    ok = (F.col("x") != "-9") & (F.col("y") != "-9")
    return each.select("file", "ind_ix", "ind", "pop", "locus", F.when(ok, F.col("x")).alias("a1"), F.when(ok, F.col("y")).alias("a2"))


def arlequin(spark: SparkSession, path: str) -> DataFrame:
    """file, ind_ix, ind, pop, locus, a1, a2 of project files with genotypic data: two lines per individual, ``?`` missing."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("t"))
    samples = whole.select("file", F.posexplode(F.expr(r"""regexp_extract_all(t, '(?s)SampleName\\s*=\\s*"[^"]*".*?SampleData\\s*=\\s*\\{[^}]*\\}', 0)""")).alias("s", "block"))
    samples = samples.select("file", "s", F.regexp_extract("block", r'SampleName\s*=\s*"([^"]*)"', 1).alias("pop"), F.split(F.regexp_extract("block", r"(?s)\{([^}]*)\}", 1), "\n").alias("ls"))
    each = samples.select("file", "s", "pop", F.posexplode("ls").alias("n", "line")).where(F.trim("line") != "").select("file", "s", "pop", "n", F.split(F.trim("line"), r"\s+").alias("c"))
    w = Window.partitionBy("file").orderBy("s", "n")
    pairs = each.withColumn("k", F.row_number().over(w) - 1).withColumn("next", F.lead("c").over(w)).where("k % 2 = 0")
    loci = pairs.select("file", (F.col("k") / 2).cast("int").alias("ind_ix"), F.col("c")[0].alias("ind"), "pop", "next", F.posexplode(F.slice("c", 3, 1_000_000)).alias("l", "x"))
    got = loci.select("file", "ind_ix", "ind", "pop", F.concat(F.lit("L"), F.col("l") + 1).alias("locus"), "x", F.expr("get(next, l)").alias("y"))
    ok = ~F.col("x").isin("?", "-9") & ~F.col("y").isin("?", "-9")
    return got.select("file", "ind_ix", "ind", "pop", "locus", F.when(ok, F.col("x")).alias("a1"), F.when(ok, F.col("y")).alias("a2"))


def with_sample_sheet(data: DataFrame, sheet: DataFrame, key: str = "ind") -> DataFrame:
    """``data`` with the columns of ``sheet``; ids match whatever their case and outer spaces, the last row of an id counts."""
    extra = [c for c in sheet.columns if c not in (key, "row")]
    order = F.col("row") if "row" in sheet.columns else F.monotonically_increasing_id()
    last = sheet.groupBy(F.lower(F.trim(key)).alias("_k")).agg(*[F.max_by(c, order).alias(f"_{c}") for c in extra])
    both = data.withColumn("_k", F.lower(F.trim(key))).join(last, "_k", "left")
    kept = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in extra else F.col(c) for c in data.columns]
    return both.select(*kept, *[F.col(f"_{c}").alias(c) for c in extra if c not in data.columns])
