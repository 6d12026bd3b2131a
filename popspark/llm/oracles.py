"""DuckDB SQL of the queries that SQL can express."""

from popspark.llm.licenses import TEMPLATES

TEMPLATE_ROWS = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES))

OP4 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(l) AS BIGINT) AS n_lines,
        CAST(length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS n_capitals
        FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END)
        + (CASE WHEN 2 * n_capitals > word_chars THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_capitals, fail_bits FROM f
"""

OP11 = r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM r AS a JOIN r AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLES = {
    "op11_hard_negatives": OP11,
    "op4_quality_rules": OP4,
}

OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS g FROM i),
sizes AS (SELECT DISTINCT m FROM win),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
g AS (SELECT doc_id, s, m, array_to_string(w[s:s + m - 1], ' ') AS g FROM p, sizes WHERE s + m - 1 <= len(w)),
o AS (SELECT doc_id, s, m, item_id FROM g JOIN win USING (m, g)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS x FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM o) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""

ORACLES["op5_decontamination"] = OP5

OP2 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[\]]', '', 'g')) AS n,
  CASE WHEN role IN ('user', 'assistant') THEN 13 ELSE 14 + length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) END AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(n + marks) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

ORACLES["op2_chat_format"] = OP2

OP6 = (
    r"""
WITH t(template, license, text) AS (VALUES """
    + TEMPLATE_ROWS
    + r"""),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, regexp_split_to_array(text, '\n[\x20\t]*\n') AS ps FROM d),
u AS (SELECT doc_id, 'l' || (unnest(range(1, len(ls) + 1)) - 1) AS unit, unnest(ls) AS x FROM l
  UNION ALL SELECT doc_id, 'p' || (unnest(range(1, len(ps) + 1)) - 1), unnest(ps) FROM l WHERE len(ps) > 1
  UNION ALL SELECT doc_id, 'p0', array_to_string(ls, chr(10)) FROM l WHERE len(ps) = 1 AND len(ls) > 1),
a AS (SELECT doc_id, unit, NULL AS template, x FROM u UNION ALL SELECT -1, license, template, text FROM t),
w AS (SELECT doc_id, unit, template, list_filter(regexp_split_to_array(regexp_replace(lower(x) || ' ', '\.([^\p{L}\p{N}])', ' \1', 'g'), '[^\p{L}\p{N}.]+'), lambda x: x <> '') AS w FROM a),
g AS (SELECT DISTINCT doc_id, unit, template, g FROM (SELECT doc_id, unit, template, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w)),
n AS (SELECT doc_id, unit, template, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT a.doc_id, a.unit, b.unit AS license, b.template, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.template IS NULL AND b.template IS NOT NULL GROUP BY ALL),
s AS (SELECT c.doc_id, c.unit, license, 2.0 * c / (x.n + y.n) AS dice FROM c JOIN n x ON x.template IS NULL AND x.doc_id = c.doc_id AND x.unit = c.unit JOIN n y ON y.template = c.template),
m AS (SELECT doc_id, arg_min(license, struct_pack(d := -dice, license := license)) AS license, max(dice) AS dice, count(DISTINCT unit) AS n_units,
  string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM (SELECT * FROM s WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) = 1) GROUP BY doc_id)
SELECT d.doc_id, license, CAST(round(dice * 1000) AS BIGINT) AS dice_millis, coalesce(n_units, 0) AS n_units, coalesce(licenses, '') AS licenses FROM d LEFT JOIN m USING (doc_id)
"""
)

ORACLES["op6_license_scan"] = OP6

OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM p),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""

ORACLES["op9_ngram_jaccard"] = OP9
