"""Reviewed cases: each test failed before its finding was mended."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import match as R
from corpusmill.operators import search as S
from corpusmill.plans import registry
from corpusmill.plans.sql import build


def test_listed_metadata_with_quotes_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ['token = "a44" is', r"C:\new\path and \"more\"", "plain words here", "tab\tand 'one'", '" \\ "']
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("web")).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(build(registry._SQL["flatten_metadata"])).fetchall()
    found = registry.QUERIES["flatten_metadata"](spark, str(tmp_path)).select("id", "language", "extra_no", "extra_list", "n").collect()
    assert sorted(map(tuple, found)) == sorted(want)


@pytest.mark.parametrize("many", [False, True])
def test_a_task_gives_k_hits_a_query_however_many_batches_it_reads(spark, monkeypatch, many):
    n, k = 1500, 3
    q = spark.range(4).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id") * 0.1).alias("q"))
    rows = spark.range(0, n, 1, 1).select(F.format_string("i%05d", F.col("id")).alias("id"), F.array(F.col("id") / n, F.lit(0.5)).alias("vector"))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, 100)
    try:
        if many:
            monkeypatch.setattr(S, "SCOPE_ITEMS", 500)
            none = F.lit(None)
            given = rows.select("id", "vector", none.cast("double").alias("page"), F.when(F.substring("id", 6, 1) < "5", "a").otherwise("b").alias("scope"))
            scopes = q.select("query_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("scope"))
            hits = S.masked_many(q.select("query_id", "q", none.alias("low"), none.alias("high")), given, scopes, k, False, "id").collect()
            cells = 4  # two scopes of 750 items in two parts each, at most a cell each
        else:
            few = q.collect()
            hits, cells = S._topk_of_few([r.query_id for r in few], np.array([r.q for r in few]), rows, k, "id").collect(), 1
    finally:
        spark.conf.unset(batch)
    assert len(hits) <= 4 * k * cells
    best = sorted({(-r.score, r.id) for r in hits if r.query_id == 2})[:k]
    assert [i for _, i in best] == [f"i{i:05d}" for i in range(n - 1, n - 1 - k, -1)]


def test_token_pairs_are_counted_where_they_meet(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = np.array(["the", "a", "of"] * 4 + [f"w{i}" for i in range(25)])
    qs = [(i, sorted({*map(str, rng.choice(words, rng.integers(0, 8)))})) for i in range(40)] + [(90, ["unseen"]), (91, [])]
    ds = [(f"d{i}", sorted({*map(str, rng.choice(words, rng.integers(0, 6)))})) for i in range(150)]
    monkeypatch.setattr(R, "HOT_ITEMS", 20)
    q, d = spark.createDataFrame(qs, "query_id long, q_tokens array<string>"), spark.createDataFrame(ds, "name string, tokens array<string>")
    pairs = R.token_overlap(q, d, ["name"])
    assert sorted(map(tuple, pairs.collect())) == sorted((i, n, len({*a} & {*b}) / len(a)) for i, a in qs for n, b in ds if {*a} & {*b})
    assert "Aggregate [query_id" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_files_by_rank_need_no_pair_of_every_common_word(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = np.array(["the", "a"] * 6 + [f"w{i}" for i in range(12)])
    qs = [(i, sorted({*map(str, rng.choice(words, rng.integers(1, 7)))})) for i in range(40)] + [(90, ["unseen"]), (91, ["the"])]
    names = [(" ".join(map(str, rng.choice(words, rng.integers(1, 5)))) + f"_{i}.pdf", i) for i in range(200)]
    q, f = spark.createDataFrame(qs, "query_id long, q_tokens array<string>"), spark.createDataFrame(names, "filename string, file_no long")
    tokens = {r.file_no: {*r.tokens} for r in R.file_tokens(f).collect()}
    want = []
    for i, a in qs:
        order = sorted((-round(len({*a} & tokens[n]) / len(a), 6), n, name) for name, n in names)[:3]
        want += [(i, rank + 1, name, -score) for rank, (score, _, name) in enumerate(order)]
    seen = []
    whole = R._shared_tokens
    monkeypatch.setattr(R, "_shared_tokens", lambda *a: seen.append(whole(*a)) or seen[0])
    assert sorted(map(tuple, R.rank_files(q, f).collect())) == sorted((i, r, n, s + 0.0) for i, r, n, s in want)
    assert seen[0].where("query_id = 91 AND size(shared) > 1 OR query_id = 91 AND first").count() == 3


def test_candidates_are_unfolded_from_lists(spark, monkeypatch):
    monkeypatch.setattr(R, "ASKING", 3)
    rng = np.random.default_rng(5)
    chunks = [(f"c{i}", f"f{rng.integers(9)}", [None, "", "t1", "t2"][rng.integers(4)], int(rng.integers(1, 6))) for i in range(120)]
    qs = [(i, None if i % 2 else 1, None if i % 2 else int(rng.integers(1, 5))) for i in range(30)]
    ms = [(int(rng.integers(30)), f"f{rng.integers(9)}", [None, "t1", "t2"][rng.integers(3)]) for _ in range(90)]
    q, m = spark.createDataFrame(qs, "query_id long, first_page int, last_page int"), spark.createDataFrame(ms, "query_id long, filename string, section_title string")
    got = R.candidate_filter(q, m, spark.createDataFrame(chunks, "id string, filename string, section_title string, page_number int"))
    want = {(i, c) for i, a, b in qs for c, f, t, p in chunks for j, mf, mt in ms if j == i and (mf == f or (mt is not None and mt == t)) and (a is None or a <= p <= b)}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and {*found} == want
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" not in text.split("asking")[0]


def test_texts_of_a_batch_are_embedded_in_pieces(spark):
    from corpusmill.functions import vectors as V

    n = 2 * V.AT_ONCE + 7
    texts = spark.range(0, n, 1, 1).select("id", F.when(F.col("id") % 50 != 3, F.concat(F.lit("one w"), F.col("id").cast("string"))).alias("text"))
    got = {r.id: r.v for r in texts.select("id", V.hash_embedding(F.col("text")).alias("v")).collect()}
    assert len(got) == n and all((got[i] is None) == (i % 50 == 3) for i in got)
    alone = spark.createDataFrame([(511, "one w511")], "id long, text string").select(V.hash_embedding(F.col("text")).alias("v")).first().v
    assert got[511] == alone


def test_random_projections_pair_nothing_in_a_shuffle(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(200, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    items = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(v)] + [("none", None), ("empty", []), ("zero", [0.0] * 8)], "id string, vector array<double>")
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(20)], "query_id long, q_vector array<double>")
    got = S.vector_topk_lsh(q, items, 5)
    assert "features" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    hits = got.collect()
    want = {(r.query_id, r.id) for r in S.vector_topk(q, items, 5).collect()}
    assert len(hits) == 100 and len({(r.query_id, r.id) for r in hits} & want) >= 90
    assert {(r.query_id, r.id) for r in hits if r["rank"] == 1} == {(i, f"v{i:03d}") for i in range(20)}
    # a vector of zeros has cosine 0, whatever its distance
    assert all(r.score == 0 for r in hits if r.id == "zero")


def test_each_text_is_cut_and_split_once(spark, tmp_path):
    from corpusmill.operators import chunks as C
    from corpusmill.sources import fixtures as X

    rows = [(0, "One. Two, three\nfour"), (1, ""), (2, None), (3, " . "), (4, "word " * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("web")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cut, blocks = C.chunk_text(docs.select("doc_id", "text")), X.blocks(spark, str(tmp_path))
    for df, function in ((cut, "regexp_extract_all("), (blocks, "split(")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count(function) == 1
    assert sorted((r.doc_id, r.chunk_index, r.total_chunks_in_page) for r in cut.collect()) == [(0, 0, 1), (3, 0, 1), *((4, i, 4) for i in range(4))]
    assert sorted((r.doc_id, r.block_no, r.text) for r in blocks.where("doc_id < 4").collect()) == [(0, 0, "One"), (0, 1, "Two"), (0, 2, "three"), (0, 3, "four")]


def test_punctuation_is_what_the_class_holds(spark):
    import re

    from corpusmill.operators import titles as TI

    points = spark.range(1, 0x11000).where("id < 55296 OR id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    found = {r.id for r in points.where(TI.has_punctuation(F.concat(F.lit("a "), "c", F.lit("b")))).collect()}
    assert found == {ord(c) for c in TI.PUNCTUATION} and all(re.search(TI.PUNCTUATION_CLASS, chr(i)) for i in found)
    # many-membered classes are slow at each character: none is asked of the blocks
    blocks = spark.createDataFrame([(1, 1, 0, "Chapter one", 0.0, 50.0, "English"), (1, 1, 1, "Chapter, two", 0.0, 50.0, "English")], "doc_id long, page_number int, block_no int, text string, x0 double, x1 double, language string")
    titles = TI.title_candidates(blocks)
    assert TI.PUNCTUATION_CLASS not in titles._jdf.queryExecution().optimizedPlan().toString()
    assert [r.title for r in titles.collect()] == ["Chapter one"]


def test_embeddings_are_brought_to_unit_length_where_they_are_counted(spark):
    from corpusmill.functions import vectors as V
    from corpusmill.operators import ingest as I

    texts = spark.createDataFrame([(0, "the cat and the dog's 3 mice"), (1, ""), (2, None), (3, "été à la mer")], "id long, text string")
    got = I.embed_text(texts)
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {r.id: r.v for r in texts.select("id", V.normalized(V.hash_embedding(F.col("text"))).alias("v")).collect()}
    assert {r.id: r.vector for r in got.collect()} == want and want[2] is None and set(want[1]) == {0.0}


def test_a_larger_search_has_few_cells_and_screens_by_largest_scores(monkeypatch):
    # 123,000 queries on 30 million items: items are repeated twice and each query has hits of 12 columns (4 and 29 before)
    assert S._grid(123_000, 30_000_000, 30, 12) == (2, 12)
    monkeypatch.setattr(S, "FRESH_HITS", 500)
    rng = np.random.default_rng(7)
    q, v = rng.normal(size=(70, 8)), rng.normal(size=(3000, 8))
    v[5] = np.nan  # hides no other item of its block
    ids = pa.array([f"i{i:04d}" for i in range(len(v))])
    near = S.Nearest(np.arange(len(q)), q, 4, "id")
    for a in range(0, len(v), 300):
        near.add(ids.slice(a, 300), v[a : a + 300])
        assert near.held - near.kept <= 500 + 70 * 4
    got = sorted(map(tuple, pa.Table.from_batches(list(near.hits())).to_pylist() and [(r["query_id"], -r["score"], r["id"]) for b in near.hits() for r in b.to_pylist()]))
    scores = np.round(np.einsum("ij,kj->ik", q, v), 6)
    want = [(i, -s, n) for i in range(len(q)) for s, n in sorted(((s, f"i{j:04d}") for j, s in enumerate(scores[i]) if s == s), key=lambda x: (-x[0], x[1]))[:4]]
    assert [(i, n) for i, _, n in got] == [(i, n) for i, _, n in want] and np.allclose([s for _, s, _ in got], [s for _, s, _ in want])


def test_outer_space_and_first_words_need_no_search_of_whole_texts(spark, tmp_path):
    from corpusmill.functions import text as T
    from corpusmill.operators import layout as L
    from corpusmill.sources import fixtures as X

    spaces = [" ", "\n", "\r\n", "\t", "\u00a0", "\u2003", "\u0085", "\u2028", "\u3000", "\u200b", "\x1c"]
    texts = [None, "", "one", "One two  three\nfour. five six seven", "x" * 70_000, "\U0001f600", "a\u00a0b c d", *spaces, *[f"{a}b c{d}" for a in ["", *spaces] for d in ["", *spaces]], *[f"{a}{d}" for a in spaces for d in spaces]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("web")).write.parquet(f"{tmp_path}/documents.parquet")
    docs, text = spark.read.parquet(f"{tmp_path}/documents.parquet"), F.col("text")
    plain = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    assert docs.where(~T.strip(text).eqNullSafe(plain) | ~T.filled(text).eqNullSafe(plain != "")).count() == 0
    for n in (1, 3, 6):
        assert docs.where(~T.first_words(text, n).eqNullSafe(F.slice(T.words(text), 1, n))).count() == 0
    # a file's name splits the head of its text alone, and pages are found without a replacement in each block
    assert "split(text" not in X.files(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(" not in L.page_text(X.blocks(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()


def sparse_vectors(rng, n, d=64, most=7):
    v = np.zeros((n, d))
    for row in v:
        at = rng.choice(d, rng.integers(1, most + 1), replace=False, p=np.arange(d, 0, -1) / (d * (d + 1) / 2))
        row[at] = rng.integers(1, 3, len(at)) * rng.choice([-1, 1], len(at))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def best_of_all(ids, q, names, v, k):
    with np.errstate(all="ignore"):
        scores = np.round(np.array([np.einsum("j,ij->i", x, v) for x in q]), 6) + 0.0
    return sorted((i, s, n) for i, row in zip(ids, scores) for s, n in sorted(((s, n) for s, n in zip(row.tolist(), names) if s == s), key=lambda x: (-x[0], x[1]))[:k])


def test_sparse_queries_are_multiplied_in_their_own_dimensions(monkeypatch):
    rng = np.random.default_rng(8)
    q = sparse_vectors(rng, 3000)
    q[10], q[2900:2950], q[20] = 0.0, q[5], -q[20]  # no token; equal queries
    v, names = np.vstack([rng.normal(size=(900, 64)), sparse_vectors(rng, 800)]), [f"i{i:05d}" for i in range(1700)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[3, 7], v[4, 8], v[1000:1040] = np.nan, 1e300, v[999]  # no number; none in single precision; copies
    near = S.Nearest(np.arange(100, 3100), q, 6, "id", whole=True)
    assert len(near.matrix) == len({tuple(x + 0.0) for x in q}) < 2960
    assert sorted(np.concatenate([own for own, _, _ in near.groups]).tolist()) == list(range(len(near.matrix)))
    for own, dims, single in near.groups:
        rest = near.matrix[own].copy()
        rest[:, dims] = 0
        assert not rest.any() and single.shape == (len(own), len(dims))
    assert sum(len(own) * len(dims) for own, dims, _ in near.groups) < 0.7 * near.matrix.size
    for a in range(0, 1700, 700):
        near.add(pa.array(names[a : a + 700]), v[a : a + 700])
    got = sorted((r["query_id"], r["score"], r["id"]) for b in near.hits() for r in b.to_pylist())
    want = best_of_all(range(100, 3100), q, names, v, 6)
    assert [(i, n) for i, _, n in got] == [(i, n) for i, _, n in want] and np.allclose([s for _, s, _ in got], [s for _, s, _ in want], rtol=1e-6)


def test_found_pairs_do_not_wait_in_any_number(monkeypatch):
    monkeypatch.setattr(S, "FOUND_PAIRS", 50)
    sizes, score = [], S.Nearest._score
    monkeypatch.setattr(S.Nearest, "_score", lambda self, at, *a: sizes.append(len(at)) or score(self, at, *a))
    monkeypatch.setattr(S, "QUERY_BLOCK", 10)
    q = np.repeat([[1.0, 0.0]], 200, axis=0) + np.arange(200)[:, None] * [0, 0.001]
    near = S.Nearest(np.arange(200), q, 3, "id", whole=True)
    near.add(pa.array([f"i{i}" for i in range(20)]), np.ones((20, 2)))  # all are equally near
    assert max(sizes) <= 50 + 10 * 20 and sum(b.num_rows for b in near.hits()) == 600


def test_a_cell_sorts_packed_items(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v, names = sparse_vectors(rng, 900), [f"i{i:05d}" for i in range(900)]
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "query_id long, q_vector array<double>")
    items = spark.createDataFrame([*zip(names, v.tolist()), ("none", None), ("empty", [])], "id string, vector array<double>").repartition(3)
    for name, value in {"FEW_QUERIES": 10, "CELL_QUERIES": 16, "CELL_ITEMS": 200, "PACK_ITEMS": 7, "GROUP_ITEMS": 30}.items():
        monkeypatch.setattr(S, name, value)
    hits = S.vector_topk(q, items, 5)
    sort = next(line for line in hits._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [cell" in line)
    assert "key" not in sort
    assert "block" in hits._jdf.queryExecution().optimizedPlan().toString()
    packed = S._packed(items.where("size(vector) > 0").select(F.lit(0).alias("column"), "id", "vector"), "id").collect()
    assert sum(len(r["items"]) for r in packed) == 900 and all(len(r["items"]) <= 7 and len(r["block"]) < 0.6 * 512 * len(r["items"]) for r in packed)
    assert sorted((r.query_id, r.score, r.id) for r in hits.collect()) == best_of_all(range(60), v[:60], names, v, 5)
