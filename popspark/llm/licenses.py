"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

A text is scanned by line and by paragraph: a licence notice is a line of its own, a
licence text a paragraph. Units are lower-cased and read as words of letters, digits
and dots, so case, punctuation and spacing don't count. For bigram sets A and B the
Dice coefficient is 2 |A & B| / (|A| + |B|). It can only reach t if
|A| <= (2 - t) / t * |B| and the reverse, so units outside every template's
size bounds are dropped before any bigram is made, and pairs outside them after.
Before that, a document must hold one of a few required words: a match shares at least
t / (2 - t) of its template's bigrams, so words that touch all but fewer of them can't
all be missing. Bigrams of the units then probe the templates' bigrams as an inverted list. All of
it is DataFrame work; no Python runs on executors.

Null and empty texts have no units; a unit of one word has no bigram and matches
nothing; of equal coefficients the smaller licence name wins. A document row is the
pair of doc_id and text; rows that repeat both give one result row. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import text_key, text_or_empty

#: A match has this coefficient at least.
THRESHOLD = 0.8

# Licence notices and the opening paragraphs of licence texts, by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, Public Domain Dedication."),
)


def words_of(text: Column) -> Column:
    """Normalised words; a dot counts only inside a word or number."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"\.(?![\p{L}\p{N}])", " "), r"[^\p{L}\p{N}.]+"), lambda w: w != "")


def _bigrams(words: str) -> Column:
    return F.expr(f"array_distinct(zip_with(slice({words}, 1, size({words}) - 1), slice({words}, 2, size({words}) - 1), (a, b) -> concat(a, ' ', b)))")


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """template, license, size, grams. Few and fixed by the caller, so always small."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    rows = rows.select("template", "license", words_of(F.col("text")).alias("w")).where(F.size("w") > 1)
    return rows.select("template", "license", _bigrams("w").alias("grams")).select("template", "license", F.size("grams").alias("size"), "grams")


def _bounds(sizes: list[int], size: Column, threshold: float) -> Column:
    """Whether a set of this size can reach the threshold with some template."""
    apart = [size.between(-(-threshold * n // (2 - threshold)), int((2 - threshold) * n / threshold)) for n in sizes]
    ok = apart[0]
    for x in apart[1:]:
        ok = ok | x
    return ok


def required_words(grams: list[list[str]], threshold: float) -> list[str]:
    """Words of which every matching text holds at least one, as part of its lower-cased characters.

    Per template, words are taken until the bigrams without them are too few for a
    match; long words and numbers first, as they are rare in other texts.
    """
    taken: dict[str, None] = {}
    for bigrams in grams:
        pairs = [set(g.split(" ")) for g in bigrams]
        least = -(-threshold * len(pairs) // (2 - threshold))
        while len(open_pairs := [p for p in pairs if p.isdisjoint(taken)]) >= least:
            words = sorted(set().union(*open_pairs))
            taken[max(words, key=lambda w: (len(w) >= 7 or w[0].isdigit(), sum(w in p for p in open_pairs), len(w)))] = None
    return list(taken)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key, unit, license, common, size, template_size, dice: the best match of each unit that has one.

    ``unit`` is "p" or "l" and the place of the paragraph or line, from 0.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates)
    grams = [r["grams"] for r in known.orderBy("template").collect()]
    sizes = sorted({len(g) for g in grams})
    least = int(-(-threshold * min(sizes) // (2 - threshold)))
    low = F.lower(text_or_empty())
    held = F.lit(False)
    for w in required_words(grams, threshold):
        held = held | F.contains(low, F.lit(w))
    one = docs.where(held).select("doc_id", text_or_empty().alias("t")).select("doc_id", text_key("t").alias("key"), "t").dropDuplicates(["doc_id", "key"]).select("doc_id", "key", F.split("t", "\n").alias("ls"), F.split("t", r"\n[\x20\t]*\n").alias("ps"))
    lines = F.transform("ls", lambda x, i: F.struct(F.concat(F.lit("l"), i.cast("string")).alias("unit"), x.alias("t")))
    paragraphs = F.when(F.size("ps") > 1, F.transform("ps", lambda x, i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("unit"), x.alias("t")))).otherwise(F.array_compact(F.array(F.when(F.size("ls") > 1, F.struct(F.lit("p0").alias("unit"), F.array_join("ls", "\n").alias("t"))))))
    units = one.select("doc_id", "key", F.explode(F.concat(lines, paragraphs)).alias("u")).select("doc_id", "key", "u.unit", "u.t")
    # A bigram takes two characters of a unit at least, so the shortest units need no splitting into words.
    units = units.where(F.length("t") >= 2 * least)
    # Bounds empty the arrays instead of filtering rows: a pushed-down filter would make every array twice.
    words = units.select("doc_id", "key", "unit", words_of(F.col("t")).alias("w"))
    none = F.array().cast("array<string>")
    sets = words.select("doc_id", "key", "unit", F.when(F.size("w") > least, _bigrams("w")).otherwise(none).alias("g"))
    sets = sets.select("doc_id", "key", "unit", F.size("g").alias("size"), F.when(_bounds(sizes, F.size("g"), threshold), F.col("g")).otherwise(none).alias("g"))
    each = sets.select("doc_id", "key", "unit", "size", F.explode("g").alias("gram"))
    lists = known.select("template", "license", F.col("size").alias("template_size"), F.explode("grams").alias("gram"))
    fits = (2.0 * F.least("size", "template_size")) >= threshold * (F.col("size") + F.col("template_size"))
    met = each.join(F.broadcast(lists), "gram").where(fits)
    counted = met.groupBy("doc_id", "key", "unit", "size", "license", "template", "template_size").agg(F.count("*").alias("common"))
    scored = counted.withColumn("dice", 2.0 * F.col("common") / (F.col("size") + F.col("template_size"))).where(F.col("dice") >= threshold)
    rank = F.struct((-F.col("dice")).alias("d"), "license", "common", "size", "template_size")
    best = scored.groupBy("doc_id", "key", "unit").agg(F.min(rank).alias("m"))
    return best.select("doc_id", "key", "unit", "m.license", "m.common", "m.size", "m.template_size", (-F.col("m.d")).alias("dice"))


def license_of(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (best match, null without one), dice_millis, n_units (matching lines and paragraphs), licenses."""
    found = scan(docs, templates, threshold)
    per = found.groupBy("doc_id", "key").agg(
        F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"),
        F.countDistinct("unit").alias("n_units"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    whole = docs.select("doc_id", text_key().alias("key")).distinct()
    both = whole.join(per.withColumnRenamed("doc_id", "id2").withColumnRenamed("key", "key2"), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")
    return both.select("doc_id", F.col("best.license").alias("license"), F.round(-F.col("best.d") * 1000).cast("long").alias("dice_millis"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), F.coalesce("licenses", F.lit("")).alias("licenses"))
