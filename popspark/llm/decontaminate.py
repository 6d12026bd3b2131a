"""Benchmark decontamination by a positional inverted index.

``postings`` stores where terms stand: one row per (term, document row) with all
positions. A benchmark item is looked up from its rarest terms: every window of the
item gets its rarest word as anchor (document counts come from all documents), the
anchors' posting lists are intersected with the item by offset, and the neighbour
words on both sides decide exactly how far document and item agree. Everything is
DataFrame work; no Python runs on executors.

Definitions: words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing
A-Z only. A window is 13 consecutive words of an item; an item of fewer words, but
not none, is one window. Null texts have no words. A document row is the pair of
doc_id and text: rows that repeat both give one result row; a doc_id with two texts
gives two; a null doc_id is a value like others. Items that repeat count once per
item_id; a null item_id never names a match, but its windows hit. Other columns of
either table are ignored.

Index terms are lower-cased by Unicode, each word alone, as the case of a letter can depend on
its neighbours; the check lower-cases A-Z only. Words that are equal to the check are one
term, so terms can only add candidates, which the exact comparison drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popspark.llm.common import stored, text_key, text_or_empty

WINDOW = 13
#: The complement of the word characters, and of A-Z, which count as words once lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Anchor terms are broadcast up to this many distinct terms (some 30 bytes each); beyond, Spark shuffles.
BROADCAST_TERMS = 100_000


def words_of(text: Column) -> Column:
    """The words in order, letter case as it is."""
    return F.filter(F.split(text, SEPARATOR), lambda w: w != "")


def lowered(words: Column) -> Column:
    """A-Z lower-cased in an array of words."""
    return F.split(F.translate(F.array_join(words, " "), UPPER, LOWER), " ")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key and text, with ``row``: a hash of doc_id and key by which rows are dealt and joined."""
    one = docs.select("doc_id", text_or_empty().alias("text"), text_key().alias("key"))
    return one.select("doc_id", "key", "text", F.xxhash64("doc_id", "key").alias("row"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The index: doc_id, key, row, term, positions (ascending, from 0).

    ``terms`` (a column ``term`` without repeats) keeps only lists that a query set
    reads; without it the index holds every term of every text.
    """
    each = keyed(docs).select("doc_id", "key", "row", F.posexplode(words_of(F.col("text"))).alias("pos", "term")).withColumn("term", F.lower("term"))
    if terms is not None:
        each = each.join(terms.select("term"), "term", "left_semi")
    lists = each.groupBy("row", "doc_id", "key", "term").agg(F.array_sort(F.collect_set("pos")).alias("positions"))
    return lists.select("doc_id", "key", "row", "term", "positions")


def _bounded(terms: DataFrame) -> DataFrame:
    """``terms``, broadcast only where a count shows that they are few."""
    return F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences over all documents, 0 included."""
    seen = docs.select(F.explode(words_of(text_or_empty())).alias("term")).select(F.lower("term").alias("term")).join(terms, "term", "left_semi").groupBy("term").count()
    return terms.join(seen, "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("n"))


def anchors(items: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, term, need, right, left: for every window of every item, its rarest word and the item's words around it.

    ``left`` runs away from the anchor. Every window holds an anchor, at most
    ``window - 1`` words from any of its words; windows that share an anchor share a row.
    """
    w = items.select("item_id", words_of(text_or_empty()).alias("raw")).where(F.size("raw") > 0)
    w = w.select("item_id", lowered(F.col("raw")).alias("w"), F.expr("transform(raw, x -> lower(x))").alias("terms"))
    w = stored(w.select("item_id", "w", "terms", F.least(F.size("w"), F.lit(window)).alias("need")).distinct(), "items")
    each = w.select("item_id", "w", "need", F.posexplode("terms").alias("p", "term"))
    terms = each.select("term").distinct()
    counted = each.join(frequencies(docs, _bounded(terms)), "term")
    back = counted.groupBy("item_id", "w", "need").agg(F.array_sort(F.collect_list(F.struct("p", "n", "term"))).alias("by_place"))
    chosen = back.select(
        "item_id",
        "w",
        "need",
        F.expr(
            """inline(array_distinct(transform(sequence(0, size(w) - need), s -> array_min(transform(
            slice(by_place, s + 1, need), x -> struct(x.n AS n, x.p AS p, x.term AS term))))))"""
        ),
    )
    return chosen.select(
        "item_id",
        "term",
        "need",
        F.expr("slice(w, p + 1, need)").alias("right"),
        F.expr(f"reverse(slice(w, greatest(p - {window - 2}, 1), p - greatest(p - {window - 2}, 1) + 1))").alias("left"),
    )


def _agree(mine: str, other: str) -> Column:
    """How many leading elements of two arrays are equal."""
    first = f"array_position(zip_with({mine}, {other}, (a, b) -> a <=> b), false)"
    return F.expr(f"CASE WHEN {first} = 0 THEN size({mine}) ELSE CAST({first} AS INT) - 1 END")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, n_words, item_id, first, last: word ranges of a document covered by an item's windows.

    Every document row is there at least once (rows that repeat, as often as they do); without an occurrence the last three are null.
    """
    found = stored(anchors(items, docs, window), "anchors")
    lists = postings(docs, _bounded(found.select("term").distinct()))
    per_row = lists.groupBy("row", "doc_id", "key").agg(F.flatten(F.collect_list("positions")).alias("places"))
    both = keyed(docs).alias("d").join(per_row.alias("p"), (F.col("d.row") == F.col("p.row")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.key") == F.col("p.key")), "left")
    tokens = both.select("d.doc_id", "d.key", "d.row", "places", words_of(F.col("d.text")).alias("w"))
    around = tokens.select(
        "doc_id",
        "key",
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.explode_outer(
            F.expr(
                f"""transform(places, p -> struct(p AS pos, lower(w[p]) AS term, slice(w, p + 1, {window}) AS r,
                reverse(slice(w, greatest(p - {window - 2}, 1), p - greatest(p - {window - 2}, 1) + 1)) AS l))"""
            )
        ).alias("x"),
    )
    few = found if found.limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS else F.broadcast(found)
    at = around.select("doc_id", "key", "row", "n_words", F.col("x.pos").alias("pos"), F.col("x.term").alias("term"), "x.r", "x.l")
    at = at.join(few, "term", "left")
    at = at.select("*", lowered(F.col("r")).alias("dr"), F.when(F.size("l") > 0, lowered(F.col("l"))).otherwise(F.array().cast("array<string>")).alias("dl"))
    at = at.select("doc_id", "key", "row", "n_words", "item_id", "pos", "need", _agree("right", "dr").alias("b"), _agree("left", "dl").alias("a"))
    true = F.coalesce(F.col("b") > 0, F.lit(False)) & (F.col("a") + F.col("b") >= F.col("need"))
    return at.select(
        "doc_id",
        "key",
        "row",
        "n_words",
        F.when(true, F.col("item_id")).alias("item_id"),
        F.when(true, F.col("pos") - F.col("a")).alias("first"),
        F.when(true, F.col("pos") + F.col("b") - 1).alias("last"),
    )


def verdicts(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """row, doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words).

    Ranges are merged in order of their start, so a word in many windows counts once.
    """
    seen = occurrences(docs, items, window)
    per_doc = seen.groupBy("row", "doc_id", "key", "n_words").agg(
        F.collect_set(F.when(F.col("first").isNotNull(), F.struct("first", "last"))).alias("ranges"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"),
    )
    covered = F.expr(
        """aggregate(array_sort(ranges), struct(0L AS n, -1 AS upto),
        (acc, x) -> struct(acc.n + greatest(0, x.last - greatest(x.first - 1, acc.upto)) AS n, greatest(acc.upto, x.last) AS upto)).n"""
    )
    counted = per_doc.select("row", "doc_id", "key", "n_words", covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``verdicts`` without the columns that identify a row."""
    return verdicts(docs, items, window, share).drop("row", "key")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated."""
    bad = stored(verdicts(docs, items, window, share).where("contaminated").select("row", F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")), "contaminated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", text_key().alias("own_key")).withColumn("own_row", F.xxhash64("doc_id", "own_key"))
    same = (F.col("own_row") == F.col("row")) & F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("own_key") == F.col("bad_key"))
    return rows.join(bad, same, "left_anti").select([F.col("whole")[c].alias(c) for c in docs.columns])


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """query, doc_id, key, start: exact places of phrases (``query``, ``words``: array, lower case) in an index.

    Lists are joined from the rarest term on; each later term only has to hold an
    offset-adjusted position among the starts that are left. An empty phrase matches nothing.
    """
    each = phrases.select("query", F.size("words").alias("m"), F.posexplode("words").alias("off", "term"))
    sizes = index.join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.size("positions")).alias("n"))
    ranked = each.join(sizes, "term", "left").groupBy("query", "m").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("ts"))
    first = ranked.select("query", "m", "ts", F.col("ts")[0]["term"].alias("term"), F.col("ts")[0]["off"].alias("off"))
    starts = index.join(first, "term").select("query", "m", "row", "doc_id", "key", F.explode("positions").alias("pos"), "off")
    starts = starts.select("query", "m", "row", "doc_id", "key", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    rest = ranked.select("query", F.explode(F.slice("ts", 2, F.greatest(F.size("ts") - 1, F.lit(0)))).alias("t")).select("query", "t.off", "t.term")
    pairs = starts.join(rest, "query", "left")
    other = index.select(F.col("row").alias("row2"), F.col("doc_id").alias("doc2"), F.col("key").alias("key2"), F.col("term").alias("term2"), "positions")
    held = pairs.join(other, (F.col("row") == F.col("row2")) & F.col("doc_id").eqNullSafe(F.col("doc2")) & (F.col("key") == F.col("key2")) & (F.col("term") == F.col("term2")), "left")
    ok = F.col("term").isNull() | F.coalesce(F.array_contains("positions", (F.col("start") + F.col("off")).cast("int")), F.lit(False))
    return held.groupBy("query", "m", "row", "doc_id", "key", "start").agg(F.min(ok).alias("ok")).where("ok").select("query", "doc_id", "key", "start")


def proximity_matches(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """query, doc_id, key: document rows that hold every term of ``words`` within ``span`` words, in any order.

    The window is opened at each posting of each query term; the other lists are
    joined on the row and on blocks of ``span`` positions, so near postings meet and far ones don't.
    """
    need = queries.select("query", F.array_distinct("words").alias("ts")).where(F.size("ts") > 0)
    terms = need.select("query", F.size("ts").alias("m"), F.explode("ts").alias("term"))
    at = index.join(terms, "term").select("query", "m", "row", "doc_id", "key", "term", F.explode("positions").alias("pos"))
    opened = at.select("query", "m", "row", "doc_id", "key", F.col("pos").alias("begin"), F.explode(F.array(F.floor(F.col("pos") / span), F.floor(F.col("pos") / span) + 1)).alias("block"))
    near = at.select(F.col("query").alias("q2"), F.col("row").alias("row2"), F.col("doc_id").alias("doc2"), F.col("key").alias("key2"), "term", "pos", F.floor(F.col("pos") / span).alias("block2"))
    same = (F.col("query") == F.col("q2")) & (F.col("row") == F.col("row2")) & F.col("doc_id").eqNullSafe(F.col("doc2")) & (F.col("key") == F.col("key2")) & (F.col("block") == F.col("block2"))
    met = opened.join(near, same).where((F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("begin") + span))
    held = met.groupBy("query", "m", "row", "doc_id", "key", "begin").agg(F.size(F.collect_set("term")).alias("got"))
    return held.where("got = m").select("query", "doc_id", "key").distinct()
