"""Each operator against a brute-force version, and on nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from corpusmill.llm import licenses, line_dedup, mixing, near_dedup, packing, quality, search, substring_dedup, suffix_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHING = ["size", "target", "copies", "found", "_doc", "_id", "_row", "_kept", "_key", "bins", "sketch", "score", "rank", "n", "h", "w", "windows", "_gone", "level", "_copies", "n_lines", "n_removed", "n_runs", "line_stats", "root", "members", "taken", "_own", "kept", "start"]


def sentence(rng, n=12):
    return " ".join(rng.choice("the of and zu der et que ".split() + [f"w{rng.randrange(400)}" for _ in range(6)]) for _ in range(n)).capitalize() + "."


def corpus(seed=1, n=60):
    """Texts with exact copies, near copies, shared passages and lines, and odd rows."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = []
    for i in range(n):
        lines = [" ".join(sentence(rng) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 9))]
        if i % 5 == 0:
            lines.insert(len(lines) // 2, passage)
        if i % 7 == 0:
            lines += ["All rights reserved.", "Line that many share, one.", "Line that many share, two.", "Line that many share, three."]
        text = "\n".join(lines)
        if i % 6 == 5:
            text = rows[-1][1]
        if i % 10 == 8:
            w = rows[-2][1].split(" ")
            w[len(w) // 2] = "edited"
            text = " ".join(w)
        rows.append((i * 3, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "ä", None]), len(text)))
    rows += [(500, None, "en", "a", 0), (501, "", "en", None, 0), (502, " \n\t ", "en", "b", 4), (503, "x" * 450, "fr", "b", 450), (504, "ab " * 300, "en", "c", 900), (505, "tiny text", None, None, 9)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def odd(spark):
    """Repeated rows, null ids, clashing columns."""
    some = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (None, None), (2, None), (3, "")]
    base = spark.createDataFrame([(i, t, None, None, None) for i, t in some], SCHEMA)
    return base.withColumns({c: F.lit(7) for c in CLASHING})


def operators(spark):
    return {
        "search": lambda d: search.search(d, d.select(F.col("doc_id").alias("query_id"), "text")),
        "line_dedup": line_dedup.dedup,
        "licenses": licenses.scan,
        "toxicity": lambda d: toxicity.with_score(d, toxicity.Grammar({}, -2.0)),
        "suffix_dedup": suffix_dedup.dedup,
        "near_dedup": near_dedup.classes,
        "keep_first": near_dedup.keep_first,
        "substring_dedup": substring_dedup.dedup,
        "plan_mix": mixing.plan_mix,
        "mix": mixing.mix,
        "pack": packing.pack,
        "quality": quality.judge,
    }


@pytest.mark.parametrize("name", ["search", "line_dedup", "licenses", "toxicity", "suffix_dedup", "near_dedup", "keep_first", "substring_dedup", "plan_mix", "mix", "pack", "quality"])
def test_odd_and_empty_tables(spark, name):
    op = operators(spark)[name]
    d = odd(spark)
    got = op(d).collect()
    per_row = {"line_dedup", "toxicity", "suffix_dedup", "near_dedup", "substring_dedup", "plan_mix", "pack", "quality"}
    if name in per_row:
        assert len(got) == 6
    if name == "keep_first":
        assert [r.doc_id for r in got] == [None, None]  # the least id, of both texts' classes
    if name == "line_dedup":
        assert all(r.n_lines == 7 and r["line_stats"] == 7 and r["line_stats_"].n_removed == 0 for r in got)
    assert op(d.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["line_dedup", "licenses", "toxicity", "suffix_dedup", "near_dedup", "substring_dedup", "plan_mix", "pack", "quality"])
def test_very_long_texts(spark, name):
    rng = random.Random(8)
    text = "\n".join(sentence(rng) for _ in range(3000))
    end = "\nan idiot you are, scum.\nReleased under the MIT License."
    d = spark.createDataFrame([(1, text + end, "en", "a", 0), (2, "start " + text + end, "en", "a", 0), (3, text, "en", "b", 0)], SCHEMA)
    got = {r.doc_id: r for r in operators(spark)[name](d).collect()}
    n = len(text.split())
    if name == "line_dedup":
        assert [got[i].line_stats.n_removed for i in (1, 2, 3)] == [0, 3001, 3000]
    elif name == "licenses":
        assert set(got) == {1, 2}
    elif name == "toxicity":
        assert got[1].score == got[2].score > got[3].score
    elif name == "suffix_dedup":
        assert got[1].n_removed == 0 and got[2].n_removed == len((text + end).encode()) and got[3].n_removed == len(text.encode())
    elif name == "near_dedup":
        assert {r.class_id for r in got.values()} == {1}
    elif name == "substring_dedup":
        assert [got[i].n_removed for i in (1, 2, 3)] == [0, n + len(end.split()), n]
    elif name == "plan_mix":
        assert got[3].size == n
    elif name == "quality":
        assert got[3].n_words == n
    else:
        assert set(got) == {1, 2, 3}


@pytest.mark.parametrize("op", [suffix_dedup, substring_dedup])
def test_texts_of_one_id_are_told_apart(spark, op):
    a, b = " ".join(f"a{i}" for i in range(120)), " ".join(f"b{i}" for i in range(120))
    d = spark.createDataFrame([(0, a), (1, a), (1, b), (2, f"start {b} end"), (None, f"x {a}"), (None, b[:90])], "doc_id long, text string")
    got = sorted(((r.doc_id, bytes(r.kept).decode()) for r in op.dedup(d).collect()), key=repr)
    assert [k for i, k in got if i == 1 and k] == [b] and len(got) == 6
    assert [k.split() for i, k in got if i == 2] == [["start", "end"]]
    assert [k for i, k in got if i == 0] == [""] and sorted(k.split() for i, k in got if i is None) == sorted([b[:90].split(), f"x {a}".split()])


def brute_bytes(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot_at", [2, 32])
def test_suffix_dedup(docs, rows, hot_at):
    got = suffix_dedup.dedup(docs, hot_at).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_bytes([r[:2] for r in rows])


@pytest.mark.parametrize("hot_at", [2, 32])
def test_substring_dedup(docs, rows, hot_at):
    first, words = {}, {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = words[d] = WORD.findall(t or "")
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), d)
    want = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < d:
                gone[s : s + 50] = [True] * 50
        want[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    got = substring_dedup.dedup(docs, hot_at).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_maximal_repeats_have_all_occurrences():
    lcp = np.array([3, 5, 5, 2, 0, 4])
    assert sorted(suffix_dedup.lcp_intervals(lcp, 1)) == [(2, 0, 4), (3, 0, 3), (4, 5, 6), (5, 1, 3)]


def test_longest_earlier():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        shared, place = rng.integers(0, 6, n - 1), rng.permutation(n)
        want = [max([min(shared[min(i, j) : max(i, j)]) for j in range(n) if place[j] < place[i]], default=-1) for i in range(n)]
        assert suffix_dedup.longest_earlier(shared, place).tolist() == want


def test_line_dedup(docs, rows):
    windows = {}
    lines = {d: [x for x in (y.strip(" \t\n\v\f\r") for y in (t or "").split("\n")) if x] for d, t, *_ in rows}
    for d in sorted(lines):
        for s in range(len(lines[d])):
            windows.setdefault(tuple(lines[d][s : s + 3]), (d, s))
            windows.setdefault(lines[d][s], (d, s))
    got = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    for d, ls in lines.items():
        gone = set()
        for s in range(len(ls) - 2):
            if windows[tuple(ls[s : s + 3])] != (d, s):
                gone |= {s, s + 1, s + 2}
        gone |= {s for s, x in enumerate(ls) if len(x) >= 100 and windows[x] != (d, s)}
        assert (got[d].line_stats.n_lines, got[d].line_stats.n_removed) == (len(ls), len(gone))
        if gone:
            assert got[d].text == "\n".join(x for i, x in enumerate(ls) if i not in gone)
    assert any(r.line_stats.n_removed for r in got.values())


def test_long_lines_of_short_texts(spark):
    long, short = "a passage " * 11, "a passage"
    texts = [long, f"{long}\n{short}", f"{short}\n{short}\n{long}x", f"{short}\nother\n{long}x\n{long}", None, ""]
    got = line_dedup.dedup(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    assert [(r.line_stats.n_lines, r.line_stats.n_removed, r.line_stats.n_runs) for r in got] == [(1, 0, 0), (2, 1, 1), (3, 0, 0), (4, 2, 1), (0, 0, 0), (0, 0, 0)]
    assert [r.text for r in got][1:4] == [short, texts[2], f"{short}\nother"]


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    d = spark.createDataFrame([(1, "Foo bar baz.\nReleased under the MIT License.\nMore text here."), (2, mit.replace(" sublicense,", "")), (3, "MIT License"), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.segment, r.template) for r in licenses.scan(d).collect()}
    assert got == {(1, "line", "MIT-line"), (2, "line", "MIT"), (1, "window", "MIT-line"), (2, "window", "MIT")}


def test_licenses_inside_other_text(spark):
    """Notices over paragraphs, in comments, inside lines, whole licences in one line and edited ones; every window against plain Python."""
    rng = random.Random(8)

    def prose(n):
        return " ".join(rng.choice("the software of this and any code is for use in copy license under notice file".split()) for _ in range(n))

    def lines(text, width, mark=""):
        w = text.split()
        return "\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width))

    t = licenses.TEMPLATES
    apache = t["Apache-2.0-notice"].replace(" You may obtain", "\n\n You may obtain").replace(" Unless", "\n\n Unless")
    gpl = t["GPL-3.0-notice"].replace(" This program is distributed", "\n\nThis program is distributed")
    edited = t["Zlib"].split()
    for k in (5, 40, 41, 90):
        edited[k] = "changed"
    texts = [
        f"import os\n\n{lines(apache, 9, '# ')}\n\nprint(1)\n{prose(60)}", f"{prose(30)}\n{gpl}\n\n{prose(400)}", "The parser is small and fast. Released under the MIT License.", f"{prose(80)} {t['MIT-full']} {prose(50)}",
        f"{prose(20)}\n{lines(' '.join(edited), 7)}\n{prose(20)}", f"{prose(300)} {t['BSD-3-Clause']}", prose(3000), "all", "", None, "All rights reserved. " * 3,
    ]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("segment = 'window'").collect()
    want = {}
    for d, text in enumerate(texts):
        own = licenses._bigrams(text or "")
        for name, template in t.items():
            g = licenses._bigrams(template)
            found = [(-round(2 * len({*own[i : i + len(g)]} & {*g}) / (len(own[i : i + len(g)]) + len(g)), 6), i) for i, x in enumerate(own) if x in g]
            if found and -min(found)[0] >= licenses.THRESHOLD:
                want[d, name] = min(found)[1], -min(found)[0]
    assert {(r.doc_id, r.template): (r.position, r.dice) for r in rows} == want and len(rows) == len(want)
    assert {(0, "Apache-2.0-notice"), (1, "GPL-3.0-notice"), (2, "MIT-line"), (3, "MIT-full"), (3, "MIT"), (4, "Zlib"), (5, "BSD-3-Clause"), (10, "All-Rights-Reserved")} <= set(want)


def test_search_is_exact(docs, rows):
    queries = docs.where("doc_id % 12 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = collections.defaultdict(list)
    for r in search.search(docs, queries, k=5, shard_words=500).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    terms = {d: collections.Counter(re.findall(r"[^\W_]+", (t or "").lower())) for d, t, *_ in rows}
    n, mean = len(terms), sum(sum(c.values()) for c in terms.values()) / len(terms)
    df = collections.Counter(w for c in terms.values() for w in c)
    for q in [d for d in terms if d % 12 == 0 and terms[d]]:
        scores = []
        for d, c in terms.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in terms[q] if w in c)
            scores.append((-round(s, 6), d))
        want = [(d, -s) for s, d in sorted(scores)[:5] if s < 0]
        assert [d for d, _ in got[q]] == [d for d, _ in want]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], atol=1e-5)


def test_blocks_under_the_threshold_are_not_read():
    """One shard of over 200 blocks, whose queries are of few words: exact, and most blocks and postings stay unread."""
    rng = np.random.default_rng(3)
    n, words = 220 * search.BLOCK + 7, 3000
    length = rng.integers(5, 40, n)
    topic = np.sort(rng.integers(0, 50, n))
    h = np.where(rng.random(length.sum()) < 0.5, rng.zipf(1.3, length.sum()) % 40, 40 + np.repeat(topic, length) * 50 + rng.integers(0, 90, length.sum())) % words
    doc, word = np.divmod(np.unique(np.repeat(np.arange(n), length) * words + h), words)
    times = np.unique(np.repeat(np.arange(n), length) * words + h, return_counts=True)[1]
    table = np.zeros((n, words))
    table[doc, word] = times
    df = (table > 0).sum(axis=0)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    weights = table * 2.2 / (table + 1.2 * (0.25 + 0.75 * length / length.mean())[:, None]) * idf
    ids = rng.permutation(n)
    index = search.Index([(ids, length, doc.astype(np.int32), word.astype(np.uint64), times.astype(np.int32))], float(n), length.mean())
    asked = [np.flatnonzero(table[d])[:size] for d, size in zip(rng.integers(0, n, 90).tolist(), [2, 4, 8, 40, 40, 40] * 15)]
    asked.append(np.zeros(0, np.int64))
    for q, (got, score) in zip(asked, index.top([(q.astype(np.uint64), df[q].astype(float)) for q in asked], 10)):
        want = np.round(weights[:, q].sum(axis=1), 6)
        order = np.lexsort((ids, -want))[:10]
        order = order[want[order] > 0]
        assert got.tolist() == ids[order].tolist() and np.allclose(score, want[order], atol=2e-6)
    assert index.blocks > 200 and index.scored < 0.5 * index.met and index.read < 0.6 * index.listed


def in_order(a, b):
    """Aligned words over all: the whole table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1] / max(len(a) + len(b) - table[-1][-1], 1)


def test_near_dedup(spark):
    rng = random.Random(3)
    texts, want = [], []
    for group in range(12):
        base = [f"g{group}w{rng.randrange(90)}" for _ in range(220)]
        texts.append(" ".join(base))
        for _ in range(40 if group == 0 else 2):
            w = list(base)
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [texts[0], texts[5], "short one", "short one", "another short", "", None]
    words = [(t or "").split() for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if words[i] == words[j] or min(len(words[i]), len(words[j])) >= 5 and in_order(words[i], words[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(d).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert near_dedup.keep_first(d).count() == len(set(got.values()))


def test_near_dedup_finds_short_texts_with_several_edits(spark):
    rng = random.Random(12)
    texts, pairs = [], []
    for _ in range(150):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 61))]
        edited = list(w)
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(edited))
            edited[k : k + 1] = rng.choice([["other"], [], [edited[k], "more"]])
        if in_order(w, edited) >= 0.8:
            pairs.append((len(texts), len(texts) + 1))
            texts += [" ".join(w), " ".join(edited)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs) > 100
    assert all(got[i] in (i, i - i % 2) for i in got)  # nothing else is linked


def test_near_dedup_finds_edited_texts_of_every_length(spark):
    """By length: words of a text, and random edits of it; of the pairs that align to the threshold 95 % are linked at each, and nothing else."""
    rng = random.Random(21)
    bands = [(5, 6, 1), (7, 9, 1), (10, 14, 1), (15, 19, 1), (20, 29, 2), (30, 45, 4), (46, 60, 6), (200, 200, 20)]
    texts, pairs = [], collections.defaultdict(list)
    for band in bands:
        while len(pairs[band]) < 120:
            w = [f"w{rng.randrange(40000)}" for _ in range(rng.randint(*band[:2]))]
            edited = list(w)
            for _ in range(band[2]):
                k = rng.randrange(len(edited))
                edited[k : k + 1] = rng.choice([[f"x{rng.randrange(40000)}"], [], [edited[k], f"x{rng.randrange(40000)}"]])
            if len(edited) >= near_dedup.SHINGLE and edited != w and in_order(w, edited) >= near_dedup.THRESHOLD:
                pairs[band].append(len(texts))
                texts += [" ".join(w), " ".join(edited)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    found = {band: sum(got[a + 1] == a for a in at) for band, at in pairs.items()}
    assert all(n >= 0.95 * 120 for n in found.values()), found
    assert all(got[i] in (i, i - i % 2) for i in got)


@pytest.mark.parametrize("side", [2, 500])
def test_large_bucket_whose_leader_is_unrelated(spark, monkeypatch, side):
    monkeypatch.setattr(near_dedup, "SIDE", side)
    texts = [" ".join(f"t{i}w{k}" for k in range(60)) for i in range(9)]
    texts.append(texts[8].replace("t8w30", "changed"))  # only these two are alike
    plain = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "_id long, text string, _name long")
    words = near_dedup.Words(pa.RecordBatch.from_arrays([pa.array(range(10), pa.int64()), pa.array(texts)], names=["_id", "text"]))
    bins = near_dedup.word_bins(words.hashes(), words.bounds)
    # they share one sketch with all others, and nothing else
    sketches = [[100 + i * near_dedup.SKETCHES + k if k != 3 else 7 for k in range(near_dedup.SKETCHES)] for i in range(10)]
    reps = spark.createDataFrame([(i, i, sketches[i], bytearray(bins[i].tobytes())) for i in range(10)], "_rep long, least long, sketches array<long>, bins binary")
    crowded = spark.createDataFrame([(i, 7, (10 - i, i)) for i in range(10)], "_rep long, sketch long, rank struct<shared: long, order: long>")
    assert {tuple(r) for r in near_dedup.leading_pairs(crowded).collect()} == {(0, i) for i in range(1, 10)}
    own = near_dedup.with_roots(crowded, spark.createDataFrame([(i, 0) for i in range(1, 6)], "_rep long, root long"))
    assert {tuple(r) for r in near_dedup.component_pairs(own).collect()} == {(0, i) for i in range(6, 10)}
    assert [tuple(r) for r in near_dedup.remaining_links(own, plain, reps).collect()] == [(8, 9)]


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    alone = [" ".join(f"t{i}w{k}" for k in range(60)) for i in range(5)]
    near = alone[4].replace("t4w30", "changed")
    given = [(None, alone[0]), (None, alone[1]), (None, alone[1]), (7, alone[2]), (7, alone[3]), (8, alone[4]), (7, near), (9, alone[3])]
    d = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    kept = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, d, "").collect())
    assert kept == collections.Counter([(None, alone[0]), (None, alone[1]), (7, alone[2]), (7, alone[3]), (7, near)])
    got = collections.Counter((r.doc_id, r.class_id, r.text_id) for r in near_dedup.classes(d).collect())
    assert got == collections.Counter({(None, None, None): 3, (7, 7, 7): 3, (8, 7, 8): 1, (9, 7, 7): 1})


def test_alignment_similarity():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.randrange(30) for _ in range(rng.randrange(1, 40))]
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = [rng.randrange(30)] * rng.randrange(2)
        assert near_dedup.similar(a, b) == (in_order(a, b) >= 0.8 - 1e-9)


def test_mixing(docs, rows):
    got = {r.doc_id: r for r in mixing.plan_mix(docs).collect()}
    size = {d: len(WORD.findall(t or "")) for d, t, *_ in rows}
    of = {d: s for d, _, _, s, _ in rows}
    names = sorted({s for s in of.values() if s is not None}) + [None]
    total = {n: sum(size[d] for d in size if of[d] == n) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    full, target = set(), {}
    while True:
        left = sum(total.values()) - sum(3 * total[n] for n in full)
        target = {n: 3.0 * total[n] if n in full else left * weight[n] / sum(weight[m] for m in names if m not in full) for n in names}
        over = {n for n in names if target[n] > 3 * total[n] and n not in full}
        if not over:
            break
        full |= over
    for d, r in got.items():
        assert r.size == size[d] and r.source_size == total[of[d]] and math.isclose(r.target, target[of[d]])
        assert r.taken in (size[d] * math.floor(r.target / max(r.source_size, 1)), size[d] * (math.floor(r.target / max(r.source_size, 1)) + 1)) and r.taken <= 3 * size[d]
    mixed = collections.Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert mixed == {d: r.copies for d, r in got.items() if r.copies}


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces = packing.pack(docs, length=256).collect()
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        documents[p.doc_id].append(p)
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0 and len(p.ids) == 4 * p.length
            at += p.length
        assert at <= 256
    for d, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(documents[d], key=lambda p: p.start)
        assert b"".join(p.ids for p in parts) == np.array(ids, "<u4").tobytes() and all(p.doc_tokens == len(ids) for p in parts)
        assert [p.start for p in parts] == list(np.cumsum([0, *[p.length for p in parts]])[:-1])


def test_encoder_matches_the_tokenizer():
    encoder = packing.Encoder(packing.default_tokenizer())
    texts = ["It's a test, isn't it? They've  gone...", "a²b ½ x y", "日本語 テキスト 한국어", "tab\tand\nnew  \n lines  ", "_under__score_ 12 345,6 Ⅷ", "<|endoftext|> in text", "naïve Öl ß", "", " lead", "é combining"]
    assert [x.tolist() for x in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_plan_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        position = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 12))])
        penalty = rng.choice([0.0, 1.0, 4.0], len(position))

        def cost(length):
            return 0 if length in (16, 8, 4) else 16 - length

        best = [0.0] + [math.inf] * (len(position) - 1)
        for j in range(1, len(position)):
            for i in range(j):
                if position[j] - position[i] <= 16:
                    best[j] = min(best[j], best[i] + cost(position[j] - position[i]) + penalty[j] + packing.SEQUENCE_COST)
        cuts = packing.plan(position, penalty, 16)
        got = sum(cost(position[b] - position[a]) + penalty[b] + packing.SEQUENCE_COST for a, b in zip(cuts, cuts[1:]))
        assert math.isclose(got, best[-1])


def test_quality_base_counts(docs, rows):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = collections.Counter(windows)
        repeated = {j for i, x in enumerate(windows) if count[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_drops_symbols_and_keeps_prose(spark):
    rng = random.Random(4)
    prose = [(i, "\n".join(sentence(rng) for _ in range(30)), "en") for i in range(20)]
    junk = [(100, " ".join(f"#$%{rng.randrange(9)}&&|{k}" for k in range(200)), "en")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string")).collect()}
    assert not got[100] and all(got[i] for i in range(20))


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = [f"c{rng.randrange(300)}" for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            words[20] = f"zork{rng.randrange(40)}x".replace("0", "a")
            words[40] = rng.choice(["idiot", "scum", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    grammar = toxicity.learn(d, lab.where(~toxicity.held_out(F.col("doc_id"))))
    got = {r.doc_id: r.score for r in toxicity.with_score(d, grammar).where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert got and all((s >= toxicity.CUT) == (i % 5 == 0) for i, s in got.items())
    assert set(got) == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_toxicity_transducers():
    near, within, ever, opened = (m(toxicity.INSULT) for m in (toxicity.near, toxicity.within, toxicity.ever, lambda x: toxicity.opened(x, (toxicity.TARGET,))))

    def run(table, symbols):
        state, seen = 0, []
        for x in symbols:
            state = table[state, x]
            seen.append(state)
        return seen

    i, o, t, b = toxicity.INSULT, toxicity.OTHER, toxicity.TARGET, toxicity.BREAK
    assert run(near, [o, i, o, o, o, i, b]) == [0, 3, 2, 1, 0, 3, 0]
    assert run(within, [o, i, o, o, b, o]) == [0, 1, 1, 1, 0, 0]
    assert run(ever, [o, i, b, o]) == [0, 1, 1, 1]
    assert run(opened, [i, o, t, i, b]) == [3, 2, 0, 3, 0]
    assert len(toxicity.ARCS) == 4**5 * 2 * 2 and all(len(row) == len(toxicity.SYMBOLS) for row in toxicity.ARCS)


def test_toxicity_grammar():
    g = toxicity.Grammar({"zork*": 3.0}, -2.0)
    w, th, no, said = toxicity.LISTED_WEIGHT, toxicity.THREAT_WEIGHT, toxicity.NEGATION_FACTOR, toxicity.REPORT_FACTOR
    for text, want in {
        "trash": [0, 0, 0, 0], "a fine day": [0, 0, 0, 0], "kill that process": [0, 0, 0, 0], "they kill time": [0, 0, 0, 0], "": [0, 0, 0, 0],
        "you idiot": [w, 0, 0, 0], "idiot, you": [w, 0, 0, 0], "idiot. you": [0, 0, 0, 0], "you one two three idiot": [0, 0, 0, 0],
        "the idiot": [0, w, 0, 0], "idiot one. two three four five moron": [0, 0, w, 0], "zorkish you": [3.0, 0, 0, 0], "zork you": [0, 0, 0, 0],
        "she is not an idiot": [w * no, 0, 0, 0] if toxicity.REACH > 4 else [0, w * no, 0, 0], "said you idiot": [w * said, 0, 0, 0],
        "i will kill you": [0, 0, 0, th], "kill idiot you": [w, 0, 0, th], "you kill idiot them": [w, 0, 0, th], "never kill you": [0, 0, 0, th * no],
    }.items():
        assert np.allclose(g.read(text), want), (text, g.read(text), want)
    assert g.score("you idiot") > toxicity.CUT and g.score("you idiot") > g.score("said you idiot") and g.score("trash") == g.score("") == g.score(None)


def test_toxicity_weights_are_fitted():
    rng = np.random.default_rng(1)
    x = rng.choice([0.0, 4.0], (4000, 4), p=[0.8, 0.2])
    y = (rng.random(4000) < 1 / (1 + np.exp(-(-3 + x @ np.array([1.5, 0.0, 0.75, 1.0]))))).astype(float)
    prior, weights = toxicity.fitted(x, y, hold=0.0)
    assert abs(prior + 3) < 0.3 and np.allclose(weights, [1.5, 0.0, 0.75, 1.0], atol=0.2)
    assert toxicity.fitted(np.zeros((5, 4)), np.zeros(5))[1] == toxicity.STANDARD


def test_quality_verdict(spark):
    """Distances and verdicts against plain Python, over texts of three languages and junk."""
    import unicodedata

    rng = random.Random(15)
    rows = []
    for i in range(60):
        lang = ["en", "de", "fr", "xx", None][i % 5]
        common = quality.COMMON_WORDS.get(lang or "", ["zzz"])
        w = [rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(30, 260))]
        text = " ".join(w).capitalize() + ("." if i % 3 else " #$% 12, 34 &&" * 30)
        rows.append((i, text if i % 11 else text.upper(), lang))
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}

    def kind(c):
        k = unicodedata.category(c)
        if k == "Lu":
            return 0
        if k[0] == "L":
            return 1
        return 5 if c in "#*$%&|<>" else 2 if k == "Nd" else 3 if c in " \t\n\v\f\r" else 4 if k[0] == "P" else 6

    shares = {}
    for d, text, _ in rows:
        w = WORD.findall(text)
        chars = collections.Counter(map(kind, text))
        listed = collections.Counter(x.lower().rstrip(".,;:!?") for x in w)
        common = [listed[x] for x in quality.LISTED]
        shares[d] = [chars[k] / len(text) for k in range(7)], [x / len(w) for x in [*common, len(w) - sum(common)]]
    refs = {}
    for d, _, lang in rows:
        if lang in quality.COMMON_WORDS and not got[d].base_failed:
            refs.setdefault(lang, []).append(d)
    means = {lang: [np.mean([shares[d][side] for d in ds], axis=0) for side in (0, 1)] for lang, ds in refs.items()}

    def distance(p, q):
        p, m = np.array(p), (np.array(p) + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            return math.sqrt(max(0.0, sum(np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)) / 2))

    for d, text, _ in rows:
        n, r = len(WORD.findall(text)), got[d]
        each = [min(distance(shares[d][side], m[side]) for m in means.values()) for side in (0, 1)]
        limits = [math.sqrt(a * a + b / n) for a, b in (quality.CLASS_LIMIT, quality.COMMON_LIMIT)]
        want = [x if n >= least else None for x, least in zip(each, (50, 100))]
        for x, y in zip((r.class_distance, r.common_distance), want):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9)
        assert r.kept == (not r.base_failed and all(x is None or x <= limit for x, limit in zip(want, limits)))
    assert {r.kept for r in got.values()} == {True, False}


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(21)
    rows = [(i, " ".join(["w"] * rng.randrange(20, 60)), "en", rng.choice(["a", "a", "a", "b", "c", "d"]), 0) for i in range(6000)]
    planned = {r.doc_id: r for r in mixing.plan_mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    for source in "abcd":
        own = [planned[i] for i, _, _, name, _ in rows if name == source]
        part = own[0].target / own[0].source_size % 1
        chance = math.sqrt(part * (1 - part) * sum(r.size**2 for r in own))  # standard deviation of the Bernoulli copies
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4 * chance + 1 and chance < 0.05 * own[0].target
