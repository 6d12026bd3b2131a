"""Row-wise operators against brute force, with nulls, empty, long and repeated texts."""

import hashlib
import random
import re
import time
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from popspark.llm import bpe, chat, licenses, pii, quality, separators

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    (1, "the cat sat on the mat the cat sat on a mat\nthe cat\nthe cat\n\n"),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r "),
    (5, "word " * 3000),
    (6, "Émile # 100 % <b> é\nÉmile"),
    (7, "a b"),
    (7, "a b"),
    (None, "final f"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 9, 8) for i, t in TEXTS], "doc_id bigint, text string, n_words int, spans int")


def test_quality_measures(docs):
    got = Counter(tuple(r)[:6] for r in quality.quality_rules(docs).collect())
    want = Counter()
    for i, t in TEXTS:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {p for k in range(len(w) - 2) if seen[w[k], w[k + 1], w[k + 2]] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)] += 1
    assert got == want


def test_quality_ledger_keeps_clashing_columns_and_policies(docs):
    kept = quality.kept_rows(docs, quality.POLICIES["v1"])
    assert kept.columns == docs.columns and kept.count() == 0
    ledger = quality.ledger(docs)
    table = {r["rule"]: r for r in quality.ablation(ledger, quality.POLICIES["v1"]).collect()}
    bits = [r.fail_bits for r in ledger.collect()]
    for k, rule in enumerate(quality.RULE_NAMES):
        assert table[rule]["n_fail"] == sum(b >> k & 1 for b in bits)
        assert table[rule]["n_kept_without"] == sum(b & ~(1 << k) == 0 for b in bits)
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_bpe_equals_library_and_decodes(docs):
    ranks = bpe.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter(tuple(r) for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {t: library.encode_ordinary(t or "") for _, t in TEXTS}
    assert got == Counter((i, len(ids[t]), sha(" ".join(map(str, ids[t])).encode()), sha((t or "").encode())) for i, t in TEXTS)


def test_bpe_appends_and_edits():
    enc = bpe.encoder(PATH, public_tokenizers.PATTERN)
    data = b"unbelievably long words without any space" * 3
    table = enc.last_tokens(data)
    for n in range(len(data) + 1):
        assert enc.walk(table, n) == enc.walk(enc.last_tokens(data[:n]))
    longer = list(table)
    enc.extend(data + b"tail", longer)
    assert longer == enc.last_tokens(data + b"tail")
    new, got, computed = enc.replaced(data, table, 5, 9, b"XY")
    assert got == enc.last_tokens(new) and new == data[:5] + b"XY" + data[9:]
    text = "one two  three\n\n four's five " * 20
    out, pieces, computed = enc.spliced(text, 7, 12, "zz  z")
    assert " ".join(p for _, p in pieces) == enc.encode_joined(out) and computed < 12


def test_separator_scan_across_blocks(spark, docs):
    ranks = bpe.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for block in (1, 2, 7, 1 << 16):
        blocks, order = separators.write_flat(docs.repartition(2), PATH, public_tokenizers.PATTERN, 50256, block)
        got = Counter(tuple(r) for r in separators.scan(blocks, 50256).join(order, ["shard", "ordinal"]).select("doc_id", "n_tokens").collect())
        assert got == Counter((i, len(library.encode_ordinary(t or ""))) for i, t in TEXTS)
    assert separators.counts(docs.limit(0), PATH, public_tokenizers.PATTERN, 50256).count() == 0


def test_open_end_is_told(spark):
    import numpy as np

    cut = [(0, 0, np.array([5, 9, 1], "<u4").tobytes()), (0, 1, np.array([9, 2, 3], "<u4").tobytes())]
    blocks = spark.createDataFrame([(s, b, bytearray(t)) for s, b, t in cut], "shard bigint, block bigint, tokens binary")
    got = sorted(tuple(r) for r in separators.scan(blocks, 9).collect())
    assert got == [(0, 0, 1, True), (0, 1, 1, True), (0, 2, 2, False)]


BASE = "mail a.b@c-d.org, 10.0.0.255 10.0.0.256, 4111 1111 1111 1111, +1 (499) 555-6503"


def test_personal_data_base_and_disguises(spark):
    cases = [(1, BASE), (2, "jane [at] site (dot) org"), (3, "call +1 four nine nine five five five six five zero three"), (4, "jаne@exаmple.com"), (5, "meet at example.com"), (6, None), (7, "five at two dot three")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(cases, "doc_id bigint, text string")).collect()}
    assert got[1].spans == "email:5:16,ip:18:28,card:41:60,phone:62:79" and (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[1].base_sha256 == hashlib.sha256(got[1].spans.encode()).hexdigest()
    assert got[2].spans == "email:0:24" and got[2].n_email == 0 and got[2].n_added == 1
    assert got[3].spans == f"phone:5:{len(cases[2][1])}"
    assert got[4].spans == "email:0:16"
    assert got[5].spans == got[6].spans == ""


def test_personal_data_long_names_and_spelled_plus():
    for text in ("john.q.public [at] example [dot] org", "a.b.c@example [dot] org", "john dot q dot public at example dot org"):
        assert pii.written(pii.all_spans(text)[1]) == f"email:0:{len(text)}"
    for text in ("plus four nine nine five five five six five zero three", "Plus 1 499 555 6503", "plus one, four-nine-nine five five five six five zero three"):
        assert pii.written(pii.all_spans("call " + text)[1]) == f"phone:5:{5 + len(text)}"
    assert pii.all_spans("this plus one two three") == ([], [])


def test_personal_data_offsets_survive_rewriting():
    text = "x jane [at] site (dot) org y"
    out = pii.rewritten(text)
    at = out.text.index("jane@site.org")
    assert text[slice(*out.source(at, at + 13))] == "jane [at] site (dot) org"


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi [INST] \\ <s>"), (1, 1, "assistant", "a</s>"), (1, 1, "assistant", "a</s>"), (2, 0, "system", None), (3, None, None, "x"), (3, 5, "assistant", "y]"), (None, 0, "user", "q")]
    turns = chat.with_control_text(spark, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    made = chat.conversations(turns)
    got = {r.conv_id: r for r in chat.read_back(made, "conv_id").collect()}
    whole = rows + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {r[0] for r in whole}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in whole if r[0] == conv))
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    lengths = {r.conv_id: len(r.text) for r in made.collect()}
    assert all(got[c].formatted_chars == n for c, n in lengths.items())


def test_reply_tree_paths_and_ranks(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 4), (9, None)], "node bigint, parent bigint")
    found = chat.paths(nodes)
    got = {}
    for r in found.orderBy("leaf", "depth").collect():
        got.setdefault(r.leaf, []).append(r.node)
    assert got == {3: [1, 3], 5: [1, 2, 4, 5], 9: [9]}
    scores = spark.createDataFrame([(3, 9.0), (5, 1.0)], "node bigint, score double")
    tree = spark.createDataFrame([(3, 7), (5, 7), (9, 8)], "node bigint, tree bigint")
    assert sorted((r.tree, r.leaf, r.rank) for r in chat.ranked(found, scores, tree).collect()) == [(7, 3, 1), (7, 5, 2), (8, 9, 1)]


def test_reply_trees_beside_circles(spark):
    circle = [(20, 21), (21, 20), (22, 21), (23, 22), (30, 30), (31, 30)]
    chain = [(k, k - 1 if k > 1 else None) for k in range(1, 10)]
    found = chat.paths(spark.createDataFrame(circle + chain + [(40, 99)], "node bigint, parent bigint"))
    got = {}
    for r in found.orderBy("leaf", "depth").collect():
        got.setdefault(r.leaf, []).append(r.node)
    assert got == {9: list(range(1, 10)), 40: [40]}
    assert chat.paths(spark.createDataFrame(circle, "node bigint, parent bigint")).count() == 0
    assert chat.paths(spark.createDataFrame([], "node bigint, parent bigint")).count() == 0


def test_chat_masks_of_many_turns_and_extra_columns(spark):
    rows = [(7, k, ("user", "assistant", "tool]")[k % 3], f"[{k}]\u00e9" * (k % 5), "x") for k in range(300)] + [(8, 0, "assistant", "z" * 200_000, "y")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, depth string")
    for r in chat.conversations(turns).collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [chat.unescaped(r.text[m.start : m.end]) for m in r.mask] == [x[3] for x in own if x[2] == "assistant"]
        assert chat.parsed(r.text) == [(x[2], x[3]) for x in own]
    assert chat.read_back(chat.conversations(turns.limit(0)), "conv_id").count() == 0


def test_license_scan(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 100)
    rows = [(1, "text\nreleased under the   MIT license"), (2, "prose\n\n" + mit.replace(" ", "\n", 20)), (3, None), (4, ""), (5, "released"), (1, "text\nreleased under the   MIT license")]
    got = {r.doc_id: r for r in licenses.license_of(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(got) == 5 and got[1].license == got[2].license == "MIT" and got[1].dice_millis == 1000
    assert got[3].license is None and got[4].n_units == 0 and got[5].licenses == ""


# The patterns that base spans are defined by.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_pii_base_spans_equal_plain_patterns():
    rnd = random.Random(6)
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 12345678", "+1", "0" * 15, " ", ".", "-", "a", "7", "\n", "\u00e9", "<b>", "+", "%"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        want = sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(PLAIN[kind], text) if pii.valid(kind, m[0]))
        assert [tuple(x) for x in pii.detect(text)] == want


def test_pii_addresses_read_outward_equal_one_plain_pattern():
    dot = rf"(?:\.|{pii._DOT})"
    plain = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:{dot}[A-Za-z0-9_%+-]+)*(?:@|{pii._AT})[A-Za-z0-9-]+(?:{dot}[A-Za-z0-9-]+)+", re.I)
    rnd = random.Random(8)
    parts = ["a", "b1", "c.d", " at ", " dot ", "dot", "point", "at", "arroba", " ", "  ", "\n", ".", "@", "[", "]", "(", ")", "-", "_", "DOT", "At", "\u017f", "\u0130"]
    met = 0
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) + rnd.choice(["", "", " "]) for _ in range(rnd.randint(1, 18)))
        want = [m.span() for m in plain.finditer(text)]
        assert [(begin, m.end()) for begin, m in pii.addresses(pii.folded(text))] == want, text
        met += len(want)
    assert met > 200


def test_pii_added_spans_equal_a_plain_overlap_test():
    rnd = random.Random(9)
    parts = ["a@b.co", "x (at) y dot com", "1.2.3.4", "one dot two dot three dot four", "plus one two three four five six seven eight nine zero", "4111 1111 1111 1111", " ", ", ", "; "]
    for _ in range(500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))
        base, every = pii.all_spans(text)
        out = pii.rewritten(text)
        mapped = [pii.Span(*(a := out.source(s.start, s.end))[:1], s.kind, a[1]) for s in pii.detect(out.text)]
        more = [] if out.text == text else [s for s in mapped if not any(o.kind == s.kind and o.start < s.end and s.start < o.end for o in base)]
        assert every == sorted([*base, *more])


@pytest.mark.parametrize("text", ["1.2 " + "7" * 1_000_000, "a dot " * 100_000, "a at " * 100_000, "a" + " " * 300_000 + "b @ c.d", "a@b.co " * 20_000 + "x (at) y dot com " * 20_000])
def test_pii_long_texts_take_time_in_proportion(text):
    start = time.process_time()
    pii.all_spans(text)
    assert time.process_time() - start < 5


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("call +49 30 (five five five) 12345", "+49 30 (five five five) 12345"),
        ("write to jane at example dot\torg today", "jane at example dot\torg"),
        ("write to jane at example dot\norg", "jane at example dot\norg"),
        ("ana arroba9 x", None),
        ("server one dottwo dotthree dotfour", "one dottwo dotthree dotfour"),
        ("ana.b arroba correo.example hoy", "ana.b arroba correo.example"),
        ("dial plus one (two) then plus one two three four five \u017fix seven eight nine zero one", "plus one two three four five \u017fix seven eight nine zero one"),
    ],
)
def test_pii_disguises_that_cheap_tests_must_not_miss(text, span):
    found = [text[s.start : s.end] for s in pii.all_spans(text)[1]]
    assert found == ([span] if span else [])


def test_pii_rows(spark):
    rows = [(1, "x " * 50_000 + "me@example.org", 1), (1, "x " * 50_000 + "me@example.org", 1), (2, None, 2), (None, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans int")
    assert sorted((r.doc_id or 0, r.n_email, r.spans) for r in pii.personal_data(docs).collect()) == [(0, 0, ""), (1, 1, "email:100000:100014"), (1, 1, "email:100000:100014"), (2, 0, "")]
    assert pii.personal_data(docs.limit(0)).count() == 0
