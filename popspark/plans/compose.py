"""Named SQL steps put together to one statement.

An operator is a SELECT over named steps (common table expressions). The statements
stay in the SQL that Spark and DuckDB share; ``series``, ``$at(list, i)$`` and
``$q(value, share)$`` (type 7 quantile), ``$joined(value ; key)$`` (a group's values as one text, by key) ``$pattern(a ; b)$`` (a group's pairs of values in any order, as a key) and ``$draw(text ; n)$`` (a whole number from 0 to n - 1 that the text decides) and ``$folded(expression of j ; n)$`` (its sum over j from 0 to n - 1, n at least 1) cover the places where they differ. ``statement`` lists the steps that a SELECT needs, in order.
"""

from __future__ import annotations

import re

STEPS: dict[str, str] = {}
QUERIES: dict[str, str] = {}


def step(name: str, sql: str) -> None:
    STEPS[name] = sql


def query(name: str, sql: str) -> None:
    QUERIES[name] = sql


def r(x: str) -> str:
    """Six decimals, and no minus zero."""
    return f"round({x}, 6) + 0e0"


def series(low: str, high: str) -> str:
    """A generator of the whole numbers from ``low`` to ``high``; the caller sees to low <= high."""
    return f"$series({low} ; {high})$"


def _series_for(engine: str, sql: str) -> str:
    made = r"explode(sequence(\1, \2))" if engine == "spark" else r"unnest(range(\1, \2 + 1))"
    sql = re.sub(r"\$at\((.*?)\)\$", r"element_at(\1)" if engine == "spark" else r"list_extract(\1)", sql)
    sql = re.sub(r"\$q\((.*?), ([0-9.]+)\)\$", r"percentile(\1, \2)" if engine == "spark" else r"quantile_cont(\1, \2)", sql)
    joined = r"array_join(transform(array_sort(collect_list(struct(\2, \1))), x -> x.\1), '')" if engine == "spark" else r"string_agg(\1, '' ORDER BY \2)"
    sql = re.sub(r"\$joined\((\w+) ; (\w+)\)\$", joined, sql)
    drawn = r"CAST(conv(substring(md5(\1), 1, 12), 16, 10) AS BIGINT) % (\2)" if engine == "spark" else r"CAST(concat('0x', substring(md5(\1), 1, 12)) AS BIGINT) % (\2)"
    sql = re.sub(r"\$draw\((.*?) ; (.*?)\)\$", drawn, sql)
    folded = r"aggregate(sequence(0, CAST(\2 AS INT) - 1), 0e0, (s, j) -> s + \1)" if engine == "spark" else r"list_sum(list_transform(range(0, CAST(\2 AS INT)), lambda j: \1))"
    sql = re.sub(r"\$folded\((.*?) ; (\w+)\)\$", folded, sql)
    summed = r"concat(bit_xor(xxhash64(\1, \2)), ' ', bit_xor(xxhash64(\2, \1, 5)))" if engine == "spark" else r"concat(bit_xor(hash(concat(\1, ' ', \2))), ' ', bit_xor(hash(concat(\2, ' ', \1, ' 5'))))"
    sql = re.sub(r"\$pattern\((\w+) ; (\w+)\)\$", summed, sql)
    return re.sub(r"\$series\(([^;]*?) ; ([^;]*?)\)\$", made, sql)


def statement(select: str, engine: str = "spark", given: dict[str, str] | None = None) -> str:
    """One statement with all steps that ``select`` names, directly or through others; ``given`` replaces steps."""
    known = STEPS | (given or {})
    order: list[str] = []

    def need(sql: str) -> None:
        for word in re.findall(r"\b[a-z_][a-z_0-9]*\b", sql):
            if word in known and word not in order and re.search(rf"\b(?:FROM|JOIN|,)\s+{word}\b", sql):
                need(known[word])
                if word not in order:
                    order.append(word)

    need(select)
    text = "WITH " + ",\n".join(f"{w} AS ({known[w]})" for w in order) + "\n" + select if order else select
    return _series_for(engine, text)
