"""Quality rules as a rule bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one failure bit per rule; a policy is a versioned mask over those bits, so a new
policy, or the question "what would go if rule r were off", reads the ledger and
never the texts. Everything is a DataFrame expression: no Python runs on executors.

Definitions: a word is a run of ``[^\\x20\\x09-\\x0D]``; a null text has no words. A
repeated word lies in a three-word window that occurs twice or more in its text.
Empty texts, texts of under three words and texts of any length have all
measurements; rows are independent, so repeated rows give repeated results, and
other columns of the input pass through ``ledger`` unless they bear its names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popspark.llm.common import text_or_empty

WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"


def _rules() -> dict[str, Column]:
    """Name -> true where a document fails."""
    n, lines = F.col("n_words"), F.col("n_lines")
    return {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "duplicate_lines": 100 * F.col("n_dup_lines") > 30 * lines,
        "short_words": F.col("word_chars") < 2 * n,
        "long_words": F.col("word_chars") > 15 * n,
        "capitals": 2 * F.col("n_capitals") > F.col("word_chars"),
    }


#: A rule's place is its bit.
RULE_NAMES = ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "capitals")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULE_NAMES.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", RULE_NAMES), Policy("v1-any-case", RULE_NAMES[:-1]))}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns and the measurements.

    Repeated windows are found inside the row: 64-bit window hashes, cut to leave
    room for the window's place, sort as plain longs; places whose cut hash has a
    neighbour are candidates, and only those are compared as words.
    """
    own = [c for c in docs.columns if c not in {*MEASURES, "_t", "_w", "_l", "_k", "_s", "_c", "_g", "_p"}]
    df = docs.select(*own, text_or_empty(text).alias("_t"))
    trimmed = F.trim("_t", F.lit(WHITE))
    df = df.select(
        *own,
        "_t",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_CLASS + "+")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "").alias("_l"),
    )
    df = df.select(
        *own,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.length(F.bin(F.size("_w").cast("long"))).alias("_k"),
    )
    df = df.select(
        *df.columns,
        F.expr(
            """CASE WHEN n_words < 4 THEN array() ELSE sort_array(transform(sequence(0L, n_words - 3L),
            i -> shiftleft(xxhash64(_w[i], _w[i + 1], _w[i + 2]), _k) | i)) END"""
        ).alias("_s"),
    )
    df = df.select(
        *[c for c in df.columns if c != "_s"],
        F.expr(
            """CASE WHEN size(_s) = 0 THEN array() ELSE transform(filter(sequence(0, size(_s) - 1),
            j -> (j > 0 AND shiftright(_s[j], _k) = shiftright(_s[j - 1], _k))
              OR (j + 1 < size(_s) AND shiftright(_s[j], _k) = shiftright(_s[j + 1], _k))),
            j -> _s[j] & (shiftleft(1L, _k) - 1L)) END"""
        ).alias("_c"),
    )
    df = df.select(
        *[c for c in df.columns if c not in ("_c",)],
        F.expr("sort_array(transform(_c, i -> struct(concat_ws(' ', _w[i], _w[i + 1], _w[i + 2]) AS g, i AS i)))").alias("_g"),
    )
    df = df.select(
        *[c for c in df.columns if c != "_g"],
        F.expr(
            """CASE WHEN size(_g) = 0 THEN array() ELSE sort_array(transform(filter(sequence(0, size(_g) - 1),
            j -> (j > 0 AND _g[j].g = _g[j - 1].g) OR (j + 1 < size(_g) AND _g[j].g = _g[j + 1].g)), j -> _g[j].i)) END"""
        ).alias("_p"),
    )
    return df.select(
        *own,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.expr(
            """aggregate(zip_with(_p, slice(_p, 2, size(_p)), (a, b) -> least(3L, coalesce(b - a, 3L))),
            0L, (total, x) -> total + x)"""
        ).alias("n_repeat_words"),
        "n_lines",
        "n_capitals",
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` (bit r: rule RULE_NAMES[r] failed), a row per row of ``docs``."""
    rules = _rules()
    bits = F.lit(0).cast("long")
    for r, name in enumerate(RULE_NAMES):
        bits = bits.bitwiseOR(F.when(rules[name], F.lit(1 << r)).otherwise(F.lit(0)).cast("long"))
    return measured(docs.drop("fail_bits"), text).withColumn("fail_bits", bits)


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(ledger_rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of ``policy``: how many documents fail it, fail it alone, and would stay without it.

    The ledger shrinks first to one count per bit pattern (at most 2 ** rules rows,
    partial on each task); the rules are answered from those by bitwise tests.
    """
    patterns = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULE_NAMES.index(r)).cast("long").alias("bit")) for r in policy.rules])
    each = patterns.select("bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_fail_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def kept_rows(docs: DataFrame, policy: Policy) -> DataFrame:
    """The rows of ``docs`` that pass ``policy`` and the base rules.

    A generator stands where a filter would: Spark would push a filter below the
    ledger's steps and so evaluate each of them many times over.
    """
    ok = passes(BASE) & passes(policy)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return ledger(rows).select(F.inline(F.when(ok, F.array("_row"))))


def quality_rules(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """doc_id, measurements, fail_bits, base_failed, kept. ``kept`` is false wherever a base rule fails."""
    rows = ledger(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes(BASE)).alias("base_failed"),
        (passes(BASE) & passes(policy)).alias("kept"),
        "n_lines",
        "n_capitals",
        "fail_bits",
    )
