"""What a sheet holds, found from the sheet itself: orientation, label columns, kind of marker; and from there a data set.

A sheet is what ``readers.delimited`` gives: file, row (0 the header), cells. Every decision reads
aggregated profiles of its columns, never the cells one by one: cells are counted by column with partial
sums on every task, and the decisions are taken in one row per file, whose size is the sheet's width. So files of any
length, and many files at once, are read alike. Distinct values are counted in full.

A sheet of a header alone, or without one, has no layout and is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popspark.dataset import Dataset
from popspark.plans.working import kept
from popspark.sources import sheets
from popspark.sources.readers import missing

# Names of label columns, in English and Spanish, and how they may end.
ID_NAME = r"(?iU)^(id|ind|individual|unit|sample|plant|tree|accession|genotype|code|otu|taxon|name|clave|individuo|muestra|planta|unidad)\b"
WORDS = {
    "pop": "pop|population|poblaci[oó]n|site|locality|location|deme|race|raza|landrace|provenance|origin|sitio|localidad|procedencia",
    "region": "region|regi[oó]n|zone|zona|group|state|estado|area|[aá]rea|cluster|subregion|watershed|province|provincia|pa[ií]s|country",
    "lat": "lat|latitude|latitud|y_?coord|northing",
    "lon": "lon|long|longitude|longitud|x_?coord|easting",
}
WHOLE = r"(?iu)^(?:{})(?:e?s)?\.?(?:[\s_-]*(?:dd|deg|dec|decimal|°|[nsewo]))?(?:\s*[(\[].*)?$"
BEGINS = r"(?iu)^(?:{})[\s_.-]"
NUMERIC = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"
# Columns among which leading labels are sought; shares that decide.
LEADING, OFFSETS = 3, 4
BINARY_CELLS, BINARY_COLUMNS, SHAPED, PAIRED, QUANTITATIVE, TEXT = 0.98, 0.9, 0.6, 0.8, 0.5, 0.6
KINDS = ("dominant", "sequence", "codominant", "morph", "haploid")


def padded(rows: DataFrame) -> DataFrame:
    """Rows with cells, as wide as the widest of their file that ends in a value; short rows get nulls at their end."""
    if "width" in rows.columns:
        return rows
    bare = rows.select("file", "row", F.transform("cells", lambda c: F.when(F.trim(c) != "", F.trim(c))).alias("cells"))
    used = F.coalesce(F.array_max(F.transform("cells", lambda c, i: F.when(c.isNotNull(), i + 1))), F.lit(0))
    wide = bare.groupBy("file").agg(F.max(used).alias("width")).where("width > 0")
    return bare.join(wide, "file").select("file", "row", "width", F.expr("transform(sequence(0, width - 1), i -> get(cells, i))").alias("cells"))


def transposed(rows: DataFrame, corner: str | None = None) -> DataFrame:
    """Sheets with rows and columns exchanged; ``corner``: the new name of the first column.

    Every cell goes to the task of its column, which is a new row: as wide as the sheet was long.
    """
    wide = padded(rows)
    number = wide.groupBy("file", "row").agg(F.max("width").alias("width"))
    order = number.select("file", "row", (F.row_number().over(Window.partitionBy("file").orderBy("row")) - 1).alias("at"))
    each = wide.join(order, ["file", "row"]).select("file", "at", F.posexplode("cells").alias("col", "v"))
    turned = each.groupBy("file", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("cells"))
    out = turned.select("file", F.col("col").alias("row"), "cells")
    if corner is None:
        return out
    return out.select("file", "row", F.when(F.col("row") == 0, F.concat(F.array(F.lit(corner)), F.slice("cells", 2, (1 << 31) - 1))).otherwise(F.col("cells")).alias("cells"))


def _number(v: Column) -> Column:
    return F.when(v.rlike(NUMERIC), v.try_cast("double"))


def matrix_profiles(rows: DataFrame) -> DataFrame:
    """file, n, binary, numeric, text, missing, distinct of all cells right of the first column and below the header."""
    each = padded(rows).where("row > 0").select("file", F.posexplode("cells").alias("col", "v")).where("col > 0")
    there = ~missing(F.col("v"))
    value = F.when(there, _number(F.col("v")))
    return each.groupBy("file").agg(
        F.count("*").alias("n"), F.count_if(value.isin(0.0, 1.0)).alias("binary"), F.count(value).alias("numeric"), F.count_if(there & value.isNull()).alias("text"), F.count_if(~there).alias("missing"), F.count_distinct(F.when(there, F.col("v"))).alias("distinct")
    )


def orientations(rows: DataFrame) -> DataFrame:
    """file, orientation, confidence: labels that repeat in the first column name loci, in the header the two columns of a locus."""
    wide = padded(rows)
    names = wide.where("row = 0").select("file", "width", F.transform(F.slice("cells", 2, (1 << 31) - 1), lambda c: F.coalesce(c, F.lit(""))).alias("h"))
    header = names.select("file", "width", (F.size(F.array_distinct("h")) < F.size("h")).alias("twice_across"))
    first = F.coalesce(F.col("cells")[0], F.lit(""))
    down = wide.where("row > 0").groupBy("file").agg(F.count("*").alias("body"), (F.count_distinct(first) < F.count("*")).alias("twice_down"))
    all_ = header.join(down, "file").join(matrix_profiles(rows), "file", "left")
    bands = (F.col("numeric") > 0) & (F.col("binary") / F.greatest("numeric", F.lit(1)) > BINARY_CELLS)
    loci = F.when(bands & F.col("twice_down") & ~F.col("twice_across"), "high").when(bands & F.col("twice_across") & ~F.col("twice_down"), None).when(bands & (F.col("body") > 3 * F.greatest(F.lit(1), F.col("width") - 1)), "medium")
    sure = bands & F.col("twice_across") & ~F.col("twice_down")
    return all_.select("file", F.when(loci.isNotNull(), "rows-are-loci").otherwise("rows-are-individuals").alias("orientation"), F.coalesce(loci, F.when(sure, "high"), F.lit("low")).alias("confidence"))


def header_pairs(rows: DataFrame) -> DataFrame:
    """file, pairs, singles, offset, over_repeated, looks_codominant: whether the header names two columns per locus, and from which column on."""
    header = padded(rows).where("row = 0").select("file", F.transform("cells", lambda c: F.coalesce(c, F.lit(""))).alias("h"))
    # Two columns of a locus: one name twice, a blank after a name, or names that end in 1 and 2 or a and b.
    pair = r"""(a = b AND a <> '') OR (b = '' AND a <> '') OR
        (b RLIKE '^(.+?)[._-]?(2|b|B)$' AND lower(regexp_replace(b, '(?i)[._-]?(2|b)$', '')) = regexp_replace(lower(a), '[._-]?(1|a)$', ''))""".replace("\\", "\\\\")
    pair = pair.replace("a =", "h[j] =").replace("a <>", "h[j] <>").replace("= b AND", "= h[j + 1] AND").replace("(b =", "(h[j + 1] =").replace("(b RLIKE", "(h[j + 1] RLIKE").replace("regexp_replace(b,", "regexp_replace(h[j + 1],").replace("lower(a)", "lower(h[j])")
    starts = "filter(sequence(0, {}), off -> off < size(h))".format(OFFSETS)
    scored = f"""transform({starts}, off -> named_struct('offset', off,
        'pairs', CASE WHEN size(h) - 2 >= off THEN size(filter(sequence(off, size(h) - 2, 2), j -> {pair})) ELSE 0 END,
        'all', CASE WHEN size(h) - 2 >= off THEN size(sequence(off, size(h) - 2, 2)) ELSE 0 END))"""
    # The first of the offsets with most pairs.
    best = f"aggregate({scored}, CAST(NULL AS STRUCT<offset: INT, pairs: INT, all: INT>), (s, x) -> CASE WHEN s IS NULL OR x.pairs > s.pairs THEN x ELSE s END)"
    named = header.select("file", F.posexplode("h").alias("col", "name")).where("name <> ''").groupBy("file", "name").count().groupBy("file").agg((F.max("count") > 2).alias("over_repeated"))
    found = header.select("file", F.expr(best).alias("x")).join(named, "file", "left").withColumn("over_repeated", F.coalesce("over_repeated", F.lit(False)))
    pairs, singles = F.col("x.pairs"), F.col("x.all") - F.col("x.pairs")
    return found.select("file", pairs.alias("pairs"), singles.alias("singles"), F.col("x.offset").alias("offset"), "over_repeated", (~F.col("over_repeated") & (pairs > 0) & (pairs >= singles)).alias("looks_codominant"))


def columns(rows: DataFrame) -> DataFrame:
    """file, col, name, n, numeric, text, missing, distinct, binary, kind, and the numbers of cells that hold a sequence, a genotype with a sign, two bases."""
    wide = padded(rows)
    names = wide.where("row = 0").select("file", F.posexplode("cells").alias("col", "name")).select("file", "col", F.coalesce("name", F.lit("")).alias("name"))
    each = wide.where("row > 0").select("file", F.posexplode("cells").alias("col", "v"))
    v = F.col("v")
    there = ~missing(v)
    value = _number(v)
    number = value.isNotNull() | v.rlike(sheets.DECIMAL_COMMA)
    shape = F.when(v.rlike(sheets.SEQUENCE), "sequence").when(v.rlike(sheets.COMBINED), "combined").when(v.rlike(sheets.TWO_LETTERS), "letters")
    found = each.groupBy("file", "col").agg(
        F.count("*").alias("n"), F.count_if(there & number).alias("numeric"), F.count_if(there & ~number).alias("text"), F.count_if(~there).alias("missing"), F.count_distinct(F.when(there, v)).alias("distinct"),
        ((F.count_if(there & ~F.coalesce(value.isin(0.0, 1.0), F.lit(False))) == 0) & (F.count_if(there) > 0)).alias("binary"), *(F.count_if(there & (shape == s)).alias(s) for s in ("sequence", "combined", "letters")),
    )
    more = F.col("numeric") > F.col("text")
    kind = F.when(F.col("binary"), "binary").when(more & (F.col("distinct") > 12), "quantitative").when(more, "discrete").otherwise("nominal")
    return found.join(names, ["file", "col"]).withColumn("kind", kind)


def _named(columns_: DataFrame) -> DataFrame:
    """Columns with is_id, is_pop, is_region, is_lat, is_lon: what their names say."""
    name, text = F.col("name"), F.col("text") > F.col("numeric")
    test = {"id": name.rlike(ID_NAME)} | {k: name.rlike(WHOLE.format(w)) for k, w in WORDS.items()}
    for k in ("pop", "region"):
        test[k] = test[k] | (name.rlike(BEGINS.format(WORDS[k])) & text)
    return columns_.select("*", *(t.alias(f"is_{k}") for k, t in test.items()))


#: Label columns in the order of the sheet: each takes the first role that its name fits and none has yet.
_ROLES = ("id", "pop", "region", "lat", "lon")


def _fold(start: str) -> str:
    def with_(role: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {'c.col' if k == role else f's.{k}'}" for k in _ROLES) + ")"

    tests = " ".join(f"WHEN s.{k} IS NULL AND c.is_{k} THEN {with_(k)}" for k in _ROLES)
    return f"aggregate(filter(cols, c -> c.col <> coalesce(({start}).id, -1)), {start}, (s, c) -> CASE {tests} ELSE s END)"


def roles(columns_: DataFrame, turned: Column | None = None) -> DataFrame:
    """file, id, pop, region, lat, lon (columns, or null), ignored (blank columns without a name). ``turned``: the sheet was transposed, so its first column is the id.

    Without a fitting name, a first text column of (nearly) unique values is the id, and one of the first four with few levels the population.
    """
    cols = F.array_sort(F.collect_list(F.struct("col", "name", "n", "numeric", "text", "missing", "distinct", *(f"is_{k}" for k in _ROLES))))
    wide = _named(columns_).groupBy("file").agg(cols.alias("cols"))
    wide = wide.withColumn("turned", F.lit(False) if turned is None else turned)
    none = "named_struct(" + ", ".join(f"'{k}', CAST({'CASE WHEN turned THEN 0 END' if k == 'id' else 'NULL'} AS INT)" for k in _ROLES) + ")"
    by_name = wide.select("file", "cols", F.expr(_fold(none)).alias("r"))
    taken = "array(r.pop, r.region, r.lat, r.lon)"
    first = f"CASE WHEN NOT coalesce(array_contains(array_compact({taken}), 0), false) AND cols[0].text > cols[0].numeric AND cols[0].distinct > cols[0].n * 0.8 THEN 0 END"
    with_id = by_name.withColumn("id", F.expr(f"coalesce(r.id, {first})"))
    few = f"filter(slice(cols, 1, {LEADING + 1}), c -> NOT array_contains(array_compact(array(id, r.region, r.lat, r.lon)), c.col) AND c.text > c.numeric AND c.distinct > 1 AND c.distinct <= greatest(2, c.n / 2))"
    return with_id.select("file", "id", F.expr(f"coalesce(r.pop, get({few}, 0).col)").alias("pop"), "r.region", "r.lat", "r.lon", F.expr("transform(filter(cols, c -> c.name = '' AND c.missing = c.n), c -> c.col)").alias("ignored"))


def marker_kinds(columns_: DataFrame, pairs: DataFrame) -> DataFrame:
    """file, kind (of KINDS), cells (combined or columns), data_columns: a cascade over the shares of columns."""
    named = F.col("is_id") | F.col("is_pop") | F.col("is_region") | F.col("is_lat") | F.col("is_lon")
    text = F.col("text") > F.col("numeric")
    label = named | ((F.col("col") <= LEADING) & text)
    scored = F.col("n") - F.col("missing")
    shaped = lambda *s: ~named & (scored > 0) & F.greatest(*(F.col(x) / scored for x in s), F.lit(0.0)).__gt__(SHAPED)
    per = _named(columns_).groupBy("file").agg(
        F.count_if(~label).alias("data"), F.count_if(~label & F.col("binary")).alias("binary"), F.count_if(~label & (F.col("kind") == "quantitative")).alias("quantitative"), F.count_if(~label & text).alias("texts"),
        F.count_if(~named).alias("candidates"), F.count_if(shaped("sequence")).alias("sequences"), F.count_if(shaped("combined", "letters")).alias("wholes"),
    ).join(pairs, "file")
    share = lambda c: F.when(F.col("data") > 0, F.col(c) / F.col("data")).otherwise(0.0)
    combined = (F.col("wholes") >= 1) & (F.col("wholes") >= 0.5 * F.greatest(F.lit(1), F.col("candidates") - 2))
    paired = F.col("looks_codominant") & (F.col("pairs") * 2 >= F.col("data") * PAIRED)
    kind = (
        F.when(share("binary") > BINARY_COLUMNS, "dominant").when(F.col("sequences") >= 1, "sequence").when(combined | paired, "codominant")
        .when(share("quantitative") > QUANTITATIVE, "morph").when(share("texts") > TEXT, "haploid").otherwise("codominant")
    )
    return per.select("file", kind.alias("kind"), F.when((kind == "codominant") & combined, "combined").otherwise("columns").alias("cells"), F.col("data").alias("data_columns"))


def layouts(rows: DataFrame) -> DataFrame:
    """file, orientation, confidence, kind, cells, data_columns, missing_code, the label columns and the ignored ones. Sheets whose rows are loci are profiled transposed."""
    return _found(rows)[0]


def _found(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The layouts, and the sheets with a row per individual."""
    rows = kept(padded(rows))
    found = kept(orientations(rows))
    turned = found.where("orientation = 'rows-are-loci'").select("file")
    straight = rows.join(turned, "file", "left_anti").select("file", "row", "width", "cells")
    over = transposed(rows.join(turned, "file", "left_semi"), "Unit").withColumn("width", F.size("cells"))
    work = kept(straight.unionByName(over))
    cols = kept(columns(work))
    by_role = roles(cols.join(turned.withColumn("turned", F.lit(True)), "file", "left").drop("turned")).join(turned.withColumn("_t", F.lit(True)), "file", "left")
    # A transposed sheet has its units in the first column, whatever else fits.
    swapped = F.col("_t") & (F.coalesce("id", F.lit(0)) == 0)
    by_role = by_role.withColumn("id", F.when(swapped, 0).otherwise(F.col("id"))).drop("_t")
    kinds = marker_kinds(cols, header_pairs(work))
    code = F.when(F.col("kind") == "codominant", "0").otherwise("")
    out = found.join(kinds, "file").join(by_role, "file").select("file", "orientation", "confidence", "kind", "cells", "data_columns", code.alias("missing_code"), *_ROLES, "ignored")
    return out, work


def paired_genotypes(sheet: DataFrame) -> DataFrame:
    """ind, pop, region, locus, a1, a2 of ``sheets.cells`` in which two columns make a locus; half a genotype counts as missing."""
    order = sheet.select("file", "col", "name").distinct()
    place = order.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("col")) - 1)
    name = F.regexp_replace("name", r"(?i)[._-](1|a)$", "")
    first = place.where("k % 2 = 0").select("file", (F.col("k") / 2).cast("int").alias("nth"), name.alias("locus"))
    both = sheet.join(place.select("file", "col", "k"), ["file", "col"]).select("file", "ind", "pop", "region", "v", (F.col("k") / 2).cast("int").alias("nth"), (F.col("k") % 2).alias("side"))
    one = both.groupBy("file", "ind", "pop", "region", "nth").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a1"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("a2"))
    return one.where("a1 IS NOT NULL AND a2 IS NOT NULL").join(first, ["file", "nth"]).select("ind", "pop", "region", "locus", "a1", "a2")


def dataset(rows: DataFrame) -> tuple[Dataset, dict]:
    """A data set from sheets whose columns nobody named, and the layout that was found; files of different layouts are refused.

    The list of layouts has a row per file.
    """
    spark = rows.sparkSession
    listed, work = _found(rows)
    found = [r.asDict() for r in listed.collect()]
    if not found:
        raise ValueError("no sheet with a header and a row")
    alike = [{k: v for k, v in f.items() if k not in ("file", "confidence")} for f in found]
    if any(k != alike[0] for k in alike):
        raise ValueError(f"files differ in layout: {[(f['file'], f['orientation'], f['kind'], f['cells']) for f in found]}")
    layout = found[0]
    own = {k: layout[k] for k in _ROLES if layout[k] is not None}
    sheet = sheets.cells(work, own, tuple(layout["ignored"]), layout["missing_code"] or None)
    kind = layout["kind"]
    if kind == "dominant":
        relations = {"bands": sheets.bands(sheet)}
    elif kind == "sequence":
        relations = {"sites": sheets.sites(sheets.sequences(sheet))}
    elif kind == "morph":
        relations = {"traits": sheets.traits(sheet)}
    elif kind == "haploid":
        relations = {"hap": sheets.haploid(sheet)}
    else:
        relations = {"geno": sheets.genotypes(sheet) if layout["cells"] == "combined" else paired_genotypes(sheet)}
    if "lat" in own and "lon" in own:
        relations["places"] = sheets.places(sheet)
    return Dataset(spark, **relations), layout
