"""Operators that join across documents, against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from popspark.llm import decontaminate, graph, jaccard, lines, toxicity

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rnd, n):
    return [rnd.choice("alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rnd.randint(0, 40)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    out = []
    for i in range(30):
        base = words(rnd, rnd.randint(60, 120))
        for k in range(rnd.choice((1, 1, 2, 5))):
            text = list(base)
            for _ in range(k):
                text[rnd.randrange(len(text))] = "changed" + str(rnd.randint(0, 9))
            out.append(" ".join(w + ("\n" if j % 12 == 11 else "") for j, w in enumerate(text)))
    out += [None, "", "  ", "one", "one", "One", "two words", out[0], out[0]]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(out)]
    rnd.shuffle(rows)
    return rows + [rows[0], (None, "a null id with its own words here", "en", "s", 1)]


def by_links(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[top(a)] = top(b)
    return [top(x) for x in range(n)]


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 9), (10, 11), (12, 12), (11, 10), (20, 1), (1, 30), (30, 2)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 10: 10, 11: 10, 20: 1, 1: 1, 30: 1, 2: 1}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_components(spark, corpus, size, percent):
    got = Counter(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(corpus, COLUMNS), size, percent).collect())
    sets = []
    for row in corpus:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), row[1] or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    n = len(corpus)
    top = by_links(n, [(i, j) for i in range(n) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])])
    least = defaultdict(lambda: None)
    for i, row in enumerate(corpus):
        if row[0] is not None:
            least[top[i]] = row[0] if least[top[i]] is None else min(least[top[i]], row[0])
    assert got == Counter((row[0], len(sets[i]), least[top[i]] if sets[i] else row[0]) for i, row in enumerate(corpus))


def test_jaccard_keeps_one_of_each(spark, corpus):
    docs = spark.createDataFrame(corpus, COLUMNS)
    kept = jaccard.one_of_each(docs)
    ids = {r.component_id for r in jaccard.near_duplicates(docs).where("n_shingles > 0").collect()}
    got = [r.doc_id for r in kept.collect() if (r.text or "").strip()]
    assert kept.columns == docs.columns and sorted(got, key=str) == sorted(ids, key=str)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_bounds_the_difference():
    rnd = np.random.default_rng(3)
    for n, m in ((5, 9), (300, 310), (100, 900)):
        both = rnd.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = np.unique(both[:n]), np.unique(both[n // 2 :])
        assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_shingles_of_batches(monkeypatch):
    texts = ["a b c d e", None, "", " \t", "A B  c\nd e", "a b", "ab", "ab\0 x", "ab x", "w" * 70 + " x y z Q", "W" * 70 + " x y z q", "w" * 71 + " x y z q", "éé É word-of-nine-or-more 日本語の言葉", "no\u00a0break"] * 3
    for piece in (1 << 20, 8):
        monkeypatch.setattr(jaccard, "PIECE", piece)
        got = [x.tolist() for x in jaccard.shingle_sets(pa.array(["left out", *texts])[1:], 4)]
        runs = []
        for t in texts:
            w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            runs.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
        # Sets are equal just where the runs of words are, and as large.
        assert [len(x) for x in got] == [len(x) for x in runs]
        assert [[x == y for y in got] for x in got] == [[x == y for y in runs] for x in runs]


def test_pairs_across_families_stay_in_their_task(spark, monkeypatch):
    """A list of many sets below the threshold gives no pair, and no pair that reaches it is lost, whatever the blocks and batches."""
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rnd.choice(base, 60, replace=False), rnd.integers(0, 1 << 63, 30, dtype=np.uint64)])) for _ in range(60)]
    sets += [np.unique(np.concatenate([x[:-1], base[:1]])) for x in sets[:5]]
    rows = [(t, s, len(x), 0, s, None if s % 3 else s, jaccard.parities(x, 512)) for t in (7, 8) for s, x in enumerate(sets)]
    listed = spark.createDataFrame(rows, "token bigint, sid bigint, n bigint, pos bigint, label bigint, family bigint, brief binary")
    near = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert len(near) >= 5
    try:
        for block, batch in ((2000, 10000), (9, 7)):
            monkeypatch.setattr(jaccard, "LIST_BLOCK", block)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = {(r.a, r.b) for r in jaccard.across_families(listed, 85).collect()}
            assert near <= got and len(got) < len(near) + 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def of_line(line):
    """What makes a line equal to another: its words, or its marks; empty if blank."""
    return lines.normalised(line) or " ".join(x for x in re.split("[ \t\x0b\x0c\r]+", line) if x)


def kept_by_brute_force(rows, least=0.8):
    """(doc_id, kept text) of each row: all pairs of lines by edit similarity alone; lines of marks by equality."""
    norms, first = [], {}
    for d, t in sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is None, x[0] or 0)):
        for k, line in enumerate(t.split("\n")):
            if norm := of_line(line):
                first.setdefault(norm, (d is None, d or 0, k))
    norms = [x.split(" ") if lines.normalised(x) else None for x in first]
    top = by_links(len(norms), [(i, j) for i in range(len(norms)) for j in range(i) if norms[i] and norms[j] and lines.similar(norms[i], norms[j], least)])
    kept = {}
    for i, at in enumerate(first.values()):
        kept[top[i]] = min(kept.get(top[i], at), at)
    place = {x: i for i, x in enumerate(first)}
    out = Counter()
    for d, t, *_ in rows:
        all_lines = (t or "").split("\n")
        left = [line for k, line in enumerate(all_lines) if not (norm := of_line(line)) or kept[top[place[norm]]] == (d is None, d or 0, k)]
        out[d, "\n".join(left) if len(left) < len(all_lines) else t] += 1
    return out


def test_line_dedup(spark, corpus):
    docs = spark.createDataFrame(corpus, COLUMNS)
    got = lines.deduped(docs)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == kept_by_brute_force(corpus)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert lines.line_dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="similarity"):
        lines.line_dedup(docs, 0.7)


def test_lines_of_marks_stay_once(spark):
    rows = [(1, "-----\nalpha beta gamma\n\n| --- | ----- |\n}"), (2, "----\n-----\ndelta\n \n|\t---  | ----- |\r\n}\n}"), (3, "-----"), (4, "\n \n"), (5, "\u2014\u2014"), (6, "\u2014\u2014"), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = lines.deduped(docs).collect()
    assert Counter((r.doc_id, r.text) for r in got) == kept_by_brute_force(rows)
    assert {r.doc_id: r.text for r in got} == {1: rows[0][1], 2: "----\ndelta\n ", 3: "", 4: "\n \n", 5: "\u2014\u2014", 6: "", 7: ""}


def test_lines_of_the_same_words_in_another_order_post_apart(spark):
    """Their size and parities agree, so only their keys tell them apart in a list."""
    rnd = random.Random(15)
    rows, shared = [], words(rnd, 9)
    for _ in range(40):
        rest = list(shared)
        rnd.shuffle(rest)
        rows.append((len(rows), " ".join(["one", "two", "three", *rest])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter((r.doc_id, r.text) for r in lines.deduped(docs).collect()) == kept_by_brute_force(rows)


@pytest.mark.parametrize("least", [0.8, 0.9])
def test_line_dedup_finds_every_near_line(spark, least):
    rnd = random.Random(12)
    rows = []
    for n in [4, 5, 5, 6, 7, 8, 9, 10, 12, 15, 20, 23, 30, 50, 120] * 6:
        base = words(rnd, n)
        other = list(base)
        for _ in range(rnd.randint(0, n // 4 + 1)):
            k = rnd.randrange(len(other))
            rnd.choice((lambda: other.__setitem__(k, "new" + str(rnd.randint(0, 999))), lambda: other.insert(k, "more"), lambda: other.pop(k) if len(other) > 2 else None))()
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, "  ".join(other).upper() + ".")]
    rows += [(len(rows), "ha ha ha ha ha ha ha ha ha ha"), (len(rows) + 1, "ha ha no ha ha ha ha no ha ha"), (len(rows) + 2, "one two three four five"), (len(rows) + 3, "two one three four five")]
    got = Counter((r.doc_id, r.text) for r in lines.deduped(spark.createDataFrame(rows, "doc_id bigint, text string"), least).collect())
    want = kept_by_brute_force(rows, least)
    assert got == want and sum(not t for _, t in want) > 20


def test_line_families_over_the_list_bounds(spark, monkeypatch):
    """A phrase that all lines share, families of more lines than LIST, lists cut into blocks, slices of few lines."""
    monkeypatch.setattr(lines, "LIST", 4)
    monkeypatch.setattr(lines, "LIST_BLOCK", 8)
    monkeypatch.setattr(lines, "MOST_LINES", 50)
    rnd = random.Random(14)
    phrase, rows = "it is a truth universally acknowledged by all readers".split(), []
    for _ in range(6):
        base = words(rnd, 12)
        for _ in range(15):
            other = list(base)
            for k in rnd.sample(range(12), rnd.randint(1, 4)):
                other[k] = rnd.choice("abcdef") * 3
            rows.append((len(rows), " ".join(phrase + other) + "\n" + " ".join(other + phrase)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter((r.doc_id, r.text) for r in lines.deduped(docs).collect()) == kept_by_brute_force(rows)


def test_pairs_of_long_lists_stay_in_their_task(spark, monkeypatch):
    """Lines that share nine words of twelve pass the bounds in great number; no table of pairs is larger than that of lines."""
    monkeypatch.setattr(lines, "LIST", 4)
    monkeypatch.setattr(lines, "LIST_BLOCK", 32)
    made, stored = Counter(), lines.stored

    def counted(df, tag):
        out = stored(df, tag)
        made[tag] = max(made[tag], out.count())
        return out

    monkeypatch.setattr(lines, "stored", counted)
    rnd = random.Random(16)
    shared = words(rnd, 9)
    rows = [(k, " ".join([*shared, *(f"{c}{k}" for c in "xyz")])) for k in range(80)]
    # Near one of these each: what differs are two words.
    rows += [(100 + k, " ".join([*shared, f"x{k}", "new", f"other{k}"])) for k in range(0, 80, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter((r.doc_id, r.text) for r in lines.deduped(docs).collect()) == kept_by_brute_force(rows)
    assert 0 < max(made["across"], made["links"]) < len(rows), made


def test_line_dedup_keeps_any_ids_and_columns(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [("b", long, 1, "x"), ("a", long.replace("w77 ", "v77 "), 2, "y"), (None, "Only one line here, of words", 3, None), ("c", "only ONE line here of words\n\u0130stanbul \u03a3\u03a3 x", 4, "z"), ("c", None, 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, r1 int, wanted string")
    got = sorted(lines.with_text_left(docs).collect(), key=lambda r: r.r1)
    assert [tuple(r) for r in got] == [rows[1], rows[3], rows[4]]
    assert {r.doc_id: r.n_dropped for r in lines.line_dedup(docs.where("text IS NOT NULL")).collect()} == {"a": 0, "b": 1, "c": 0, None: 1}


def test_line_distance():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 25))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert lines.distance(a, b) == row[-1]
        n = max(len(a), len(b))
        assert lines.similar(a, b) == (5 * row[-1] <= n)


def test_decontamination(spark, corpus):
    rnd = random.Random(8)
    items = [(1, " ".join(words(rnd, 30))), (2, " ".join(words(rnd, 5))), (3, ""), (4, None), (5, "ok " * 20), (5, " ".join(words(rnd, 13))), (None, " ".join(words(rnd, 14)))]
    docs = list(corpus[:30])
    for i, (_, t) in enumerate(items):
        w = (t or "x").split()
        docs.append((1000 + i, " ".join(words(rnd, 20) + [x.upper() + "," for x in w[2:18]] + words(rnd, 9)), "en", "s", 1))
        docs.append((2000 + i, "; ".join(w[:12]) + ". " + " ".join(words(rnd, 400)) + " " + " ".join(w), "en", "s", 1))
    docs += [docs[-1], (3000, "ok " * 12, "en", "s", 1), (3001, "OK-" * 13, "en", "s", 1)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = set()
    for d, t, *_ in docs:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            v = split(text)
            m = min(13, len(v))
            windows = {tuple(v[s : s + m]) for s in range(len(v) - m + 1)} if v else set()
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
                    found.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        want.add((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    table, bench = spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in decontaminate.decontamination(table, bench).collect()}
    assert got == want
    clean = decontaminate.clean(table, bench)
    assert clean.columns == table.columns and {r.doc_id for r in clean.collect()} == {w[0] for w in want if not w[5]}
    assert decontaminate.decontamination(table, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontamination(table.limit(0), bench).count() == 0


def test_decontamination_folds_each_word_alone(spark):
    item = "w0 w1 w2 w3 w4 w5 \u0391\u03a3'\u0392 v0 v1 v2 v3 v4 v5"
    docs = [(1, f"x {item} y"), (2, f"X {item.upper()} Y"), (3, f"x {item.replace(chr(39), '. ')} y"), (4, "\u0130 w0 w1")]
    columns = "doc_id bigint, text string, row int, bad_id int, _key int, own_key int"
    frame = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], columns)
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontamination(frame, bench).collect()}
    assert got == {1: (16, 14, 1), 2: (16, 14, 1), 3: (16, 14, 1), 4: (3, 0, 0)}
    clean = decontaminate.clean(frame, bench)
    assert clean.columns == frame.columns and [tuple(r) for r in clean.collect()] == [(*docs[3], 1, 2, 3, 4)]
    assert {r.doc_id for r in jaccard.one_of_each(frame.withColumnRenamed("row", "_n")).collect()} <= {1, 2, 3, 4}


def test_phrase_and_proximity(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat"), (2, "on the mat the cat"), (3, "mat mat mat"), (4, None)], "doc_id bigint, text string")
    index = decontaminate.postings(docs)
    ask = spark.createDataFrame([("a", ["the", "cat"]), ("b", ["mat", "mat"]), ("c", ["dog"]), ("d", [])], "query string, words array<string>")
    assert sorted((r["query"], r.doc_id, r.start) for r in decontaminate.phrase_matches(index, ask).collect()) == [("a", 1, 0), ("a", 2, 3), ("b", 3, 0), ("b", 3, 1)]
    near = spark.createDataFrame([("x", ["sat", "mat"]), ("y", ["mat", "cat"])], "query string, words array<string>")
    assert sorted((r["query"], r.doc_id) for r in decontaminate.proximity_matches(index, near, 3).collect()) == [("y", 2)]
    assert sorted((r["query"], r.doc_id) for r in decontaminate.proximity_matches(index, near, 5).collect()) == [("x", 1), ("y", 1), ("y", 2)]


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 3 == 0, i % 5 == 0
        text = words(rnd, 60) + (["junkword"] * 2 if bad else []) + ([rnd.choice(("nasty", "vile", "awful"))] if toxic else [])
        rnd.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "nasty " * 5000)]
    labels += [(1, None, 1), (7777, 1, 1)]
    train = [x for x in labels if x[0] % 2]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(train, "doc_id bigint, quality int, toxic int"), ["quality", "toxic"]).collect()}
    assert len(got) == len(rows)
    held = [x for x in labels if x[0] % 2 == 0 and x[0] < 600]
    assert sum(got[i].toxic == bool(t) for i, _, t in held) >= 0.97 * len(held)
    assert sum((got[i].p_quality > 0.5) == bool(q) for i, q, _ in held) >= 0.97 * len(held)
    assert not got[1000].toxic and not got[1001].toxic and got[1002].toxic


def test_pipeline_stages_keep_columns_and_do_their_work(spark, corpus, tmp_path):
    rnd = random.Random(9)
    item = " ".join(words(rnd, 25))
    docs = [r for r in corpus if r[0] is not None][:-1] + [(5000, item + " " + " ".join(words(rnd, 60)), "en", "s", 1), (5001, "% & | " * 40, "en", "s", 1)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        frame = spark.createDataFrame(frame.collect(), COLUMNS)
        seen.append({r.doc_id for r in frame.collect()})
    assert 5001 not in seen[0] and 5000 in seen[2] and 5000 not in seen[3]
    assert seen[3] < seen[2] <= seen[1] <= seen[0]
    texts = [r.text for r in frame.collect()]
    norms = [lines.normalised(x) for t in texts for x in t.split("\n") if lines.normalised(x)]
    assert len(norms) == len(set(norms))
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in done.collect()} == seen[3]
