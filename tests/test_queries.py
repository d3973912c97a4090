"""Every query with SQL gives the SQL's rows on the smallest table set; a few plans and rules by hand."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corpusmill.functions import text as T
from corpusmill.functions import vectors as V
from corpusmill.operators import chunks as C
from corpusmill.operators import dialogs as D
from corpusmill.operators import ingest as I
from corpusmill.operators import layout as L
from corpusmill.operators import match as R
from corpusmill.operators import search as S
from corpusmill.operators import titles as TI
from corpusmill.plans import registry
from corpusmill.streaming import streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["merge_paragraphs", "words_to_lines", "page_text", "titles", "page_sections", "chunk_text", "chunks", "embed_text", "section_index", "candidate_filter", "vector_topk", "search_keyword", "smart_retrieval", "citations", "dialog_context", "stream_ingest", "stream_dialogs", "scalar_helpers", "json_chunks", "ingest_dedup", "store_vectors", "section_index_saved", "section_vectors_saved", "page_text_limited", "titles_check", "rerank_model", "vector_topk_index_all", "vector_topk_filtered", "search_smart", "section_match", "flip_blocks", "list_files", "block_source", "page_sections_default", "ingest_indexed", "build_totals", "embed_cached", "stream_last_messages", "dialog_log", "dialog_histories", "human_sizes", "flatten_metadata", "results_page", "stream_build", "map_helpers", "punctuated_blocks", "store_rebuilt", "build_modes", "queries_from_file", "embed_failures", "page_text_chapters", "dialog_append"])
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    result = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(v) for v in row) for row in result.fetchall())
    assert sorted(tuple(norm(r[c]) for c in names) for r in df.collect()) == want


def test_every_query_has_sql_or_a_reason():
    assert set(registry.QUERIES) - set(registry.oracle_sql()) == {"vector_topk_lsh", "vector_topk_index", "segment_words", "rerank_trained"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_and_plans(spark):
    assert __spark_entry__.entry(spark).count() > 0
    plan = registry.match_files_sections(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "embedding" not in registry.dialog_list(spark, SF)._jdf.queryExecution().executedPlan().toString()


def block(spark, rows):
    return spark.createDataFrame([(1, 1, i, t, 0.0, float(y0), 100.0, float(y1)) for i, (t, y0, y1) in enumerate(rows)], "doc_id long, page_number int, block_no int, text string, x0 double, y0 double, x1 double, y1 double")


def test_paragraphs_end_with_their_last_line(spark):
    got = L.merge_paragraphs(block(spark, [("a", 0, 10), ("b", 12, 40), ("c", 14, 20), ("d", 25, 30), ("e", 35, 36)])).orderBy("y0").collect()
    assert [(r.text, r.y1) for r in got] == [("a b c", 20.0), ("d", 30.0), ("e", 36.0)]


def test_page_text_counts_blank_blocks_in_gaps(spark):
    assert L.page_text(block(spark, [("a", 0, 10), (" ", 20, 28), ("b", 30, 40), ("c", 51, 60)])).first().text == "a b\nc"


def test_asian_layout_rules(spark):
    clean = L.clean_blocks_ja(block(spark, [("12", 400, 500), ("12", 400, 500.1), ("高い", 0, 200), ("高すぎる", 0, 200.1), ("a\nb", 0, 5)]))
    assert [r.text for r in clean.orderBy("block_no").collect()] == ["12", "高い", "ab"]
    flipped = L.flip_blocks(block(spark, [("latin", 0, 10)]).union(block(spark, [("か", 0, 10)]).withColumn("page_number", F.lit(2))), 792.0).collect()
    assert [(r.page_number, r.y0, r.y1) for r in flipped] == [(2, 782.0, 792.0)]


def test_title_shapes(spark):
    texts = {"第一章": True, "第一章 あいうえお": False, "あいうえおかきく": True, "あいうえおかきくけ": False, "One two three four five six seven": True, "One two three four five six seven eight": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.ok for r in df.select("t", TI.length_ok(F.col("t"), F.lit("English")).alias("ok")).collect()} == texts
    # the word rule is for English documents only: Latin text of others may have 7 characters
    latin = {"Un deux": True, "Un deux trois": False, "第一章": True, "あいうえおかきく": True}
    for language in ("French", None):
        df = spark.createDataFrame([(t,) for t in latin], "t string")
        assert {r.t: r.ok for r in df.select("t", TI.length_ok(F.col("t"), F.lit(language).cast("string")).alias("ok")).collect()} == latin
    centred = spark.createDataFrame([(1, "French", 1, 0, "Un deux trois quatre", 250.0, 0.0, 350.0, 5.0), (1, "French", 1, 1, "Un deux", 250.0, 6.0, 350.0, 9.0), (1, "French", 1, 2, "x" * 9, 0.0, 9.0, 600.0, 12.0)], "doc_id long, language string, page_number int, block_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.title for r in TI.title_candidates(centred).collect()] == ["Un deux"]
    rows = [(1, "English", 1, 0, "chapter one", 0.0, 0.0, 10.0, 5.0), (1, "English", 1, 1, "Chapter one", 0.0, 6.0, 100.0, 9.0), (1, "English", 2, 2, "Chapter：two", 0.0, 0.0, 100.0, 5.0)]
    blocks = spark.createDataFrame(rows, "doc_id long, language string, page_number int, block_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.title for r in TI.title_candidates(blocks).collect()] == ["Chapter one"]


def test_late_titles(spark):
    def found(titles):
        c = spark.createDataFrame([(1, p, i, t, p, 20) for i, (p, t) in enumerate(titles)], "doc_id long, page_number int, block_no int, title string, page_pos int, last_page int")
        return [(r.title, r.start_page, r.end_page) for r in TI.section_ranges(TI.titles(c)).orderBy("seq").collect()]

    assert found([(10, "a"), (10, "b"), (12, "c")]) == [("a", 10, 11), ("c", 12, 20)]
    assert found([(11, "a"), (12, "b"), (13, "a")]) == [("a", 11, 20)]
    assert found([(11, "a"), (11, "b")]) == [("a", 11, 10), ("b", 11, 20)]


@pytest.mark.parametrize("text", ["x" * 512, "x" * 513, "x" * 256 + "." + "y" * 400, "x" * 257 + "." + "y" * 400, "字" * 300 + "。" + "字" * 600, "a" * 520 + " " * 300, ""])
def test_chunks_follow_the_rule(spark, text):
    want, start = [], 0
    while start < len(text):
        end = start + 512
        if end < len(text):
            stop = max(text.rfind("。", start, end), text.rfind(".", start, end))
            end = stop + 1 if stop > start + 256 else end
        if text[start:end].strip():
            want.append(text[start:end].strip())
        start = end - 50 if end < len(text) else end
    got = C.chunk_text(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert [r.text for r in got] == want


def test_text_functions(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first().v

    lit = F.lit
    assert value(T.tokens(lit("Naïve it's 2"))) == ["na", "ve", "it's", "2"] and value(T.tokens(lit("第 一"))) == ["第", "一"] and value(T.tokens(lit("カ a"))) == ["カ", "a"] and value(T.tokens(lit(""))) == []
    assert [value(T.valid_section_title(lit(t))) for t in ("2024", "第12", "一二三", "Chapter 1", " ")] == [False, True, False, True, False]
    assert [tuple(value(c) for c in T.page_range(lit(q))) for q in ("第10-20页", "10至20", "10 到 20", "none", "1-99999999999")] == [(10, 20), (10, 20), (10, 20), (None, None), (1, None)]
    assert value(T.jaccard(lit(""), lit(" "))) == 1.0 and value(T.safe_divide(lit(1.0), lit(0.0), 9.0)) == 9.0
    assert [value(T.human_size(lit(n))) for n in (0, 1024, 1536, 5)] == ["0B", "1.0 KB", "1.5 KB", "5.0 B"]
    assert [value(T.extension(lit(n))) for n in ("a.PDF", ".bashrc", "x", "a.tar.gz")] == ["pdf", "", "", "gz"]
    assert value(T.truncated(lit("x" * 100))) == "x" * 100 and value(T.truncated(lit("x" * 101))) == "x" * 97 + "..."


def test_ingest_keeps_duplicates_of_one_file(spark):
    new = spark.createDataFrame([(1, 0, "h"), (1, 1, "h"), (3, 0, "h"), (3, 1, ""), (5, 0, "s")], "doc_id long, chunk_index int, text_hash string")
    stored = spark.createDataFrame([("s",)], "text_hash string")
    assert sorted((r.doc_id, r.chunk_index) for r in I.ingest_dedup(new, stored).collect()) == [(1, 0), (1, 1), (3, 1)]


def test_failed_texts_have_null_vectors(spark):
    def make():
        def predict(texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return [[1.0, float(len(t))] for t in texts]

        return predict

    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "id long, text string").coalesce(1)
    assert {r.id: r.vector for r in I.predict_embeddings(rows, make).collect()} == {1: [1.0, 4.0], 2: None, 3: [1.0, 4.0]}


def test_scores(spark):
    hits = spark.createDataFrame([(1, "a", 0.5)], "query_id long, id string, score double")
    assert S.minmax(hits).first().score == 0.5
    q = I.embed_text(spark.createDataFrame([(1, "")], "query_id long, query string"), "query").withColumnRenamed("vector", "q_vector")
    items = I.embed_text(spark.createDataFrame([("x", "some text"), ("y", "other")], "id string, text string"))
    assert [(r.id, r.score) for r in S.vector_topk(q, items, 1).collect()] == [("x", 0.0)]
    assert abs(items.select(V.norm(F.col("vector")).alias("n")).first().n - 1) < 1e-9


def test_grid_of_queries_and_items_gives_the_same_hits(spark, monkeypatch):
    def unit(c):
        return V.normalized(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.xxhash64(c, i) % 3).cast("double")))

    q = spark.range(70).select(F.col("id").alias("query_id"), unit(F.col("id")).alias("q_vector"))
    items = spark.range(300).withColumnRenamed("id", "n").select(F.concat(F.lit("i"), "n").alias("id"), unit(-F.col("n")).alias("vector")).union(spark.createDataFrame([("none", None), ("empty", [])], "id string, vector array<double>"))
    want = sorted(map(tuple, S.vector_topk(q, items, 7).collect()))
    assert len(want) == 70 * 7
    for name, value in {"FEW_QUERIES": 10, "CELL_QUERIES": 16, "CELL_ITEMS": 64, "QUERY_BLOCK": 5}.items():
        monkeypatch.setattr(S, name, value)
    assert sorted(map(tuple, S.vector_topk(q, items, 7).collect())) == want
    assert S.vector_topk(q, items.limit(0), 7).count() == 0
    monkeypatch.undo()
    assert S.vector_topk(q.limit(0), items, 7).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_approximate_hits_are_the_exact_ones_nine_times_of_ten(spark):
    q, c = registry.passages(spark, SF).cache(), registry.chunk_vectors(spark, SF).select("id", "vector").cache()
    want = {(r.query_id, r.id) for r in S.vector_topk(q, c, 10).collect()}
    found = {(r.query_id, r.id) for r in S.vector_topk_lsh(q, c, 10).collect()}
    assert len(want & found) >= 0.9 * len(want)


VECTOR_ROWS = "id string, language string, vector array<double>"


def test_store_takes_vectors_of_one_dimension(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = spark.createDataFrame([("a", "en", [1.0, 0.0]), ("b", "en", []), ("c", "fr", None)], VECTOR_ROWS)
    assert I.append_vectors(rows, path) == 2
    three = spark.createDataFrame([("d", "en", [1.0, 0.0, 0.0])], VECTOR_ROWS)
    for bad in (three, three.union(rows)):
        with pytest.raises(ValueError):
            I.append_vectors(bad, path)
    assert I.append_vectors(spark.createDataFrame([], VECTOR_ROWS), path) == 0
    assert I.append_vectors(spark.createDataFrame([("e", "fr", [0.0, 1.0])], VECTOR_ROWS), path) == 0
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "e"]
    assert I.append_vectors(three, path, "overwrite") == 0
    assert [r.id for r in spark.read.parquet(path).collect()] == ["d"]


def test_saved_tables_are_valid_or_built_again(spark, tmp_path):
    path, built = f"{tmp_path}/t", spark.createDataFrame([("a", 1)], "name string, n int")
    assert I.saved(spark, path, {"name": "string"}) is None
    assert I.saved_or_built(spark, path, built, ("name",)).collect() == built.collect()
    other = spark.createDataFrame([("b", 2)], "name string, n int")
    assert I.saved_or_built(spark, path, other, ("name",)).first().name == "a"
    assert I.saved_or_built(spark, path, other, ("name",), rebuild=True).first().name == "b"
    assert I.saved(spark, path, {"n": "bigint"}) is None
    spark.createDataFrame([(None, 1)], "name string, n int").write.mode("overwrite").parquet(path)
    assert I.saved(spark, path, {"name": "string"}, ("name",)) is None
    assert I.saved_or_built(spark, path, built, ("name",)).first().name == "a"


def test_json_documents_that_cannot_be_read_are_skipped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    parent = '{"parent_document": {"filename": "f.pdf", "language": "English"}'
    (tmp_path / "a.json").write_text(parent + ',\n "document_chunks": [{"id": "1", "text": "one", "text_hash": "h"},\n {"id": "2", "text": "two"}]}')
    (tmp_path / "in" / "b.json").write_text(parent + "}")
    (tmp_path / "in" / "c.json").write_text("{not json")
    found = I.read_json_docs(spark, str(tmp_path)).collect()
    assert sorted((r.filename, r.position, r.id, r.text) for r in found) == [("f.pdf", 0, "1", "one"), ("f.pdf", 1, "2", "two")]


def test_build_modes(spark, tmp_path):
    def docs(*texts):
        rows = [(n, "f.pdf", f"data/{n}", 1, "English", 1, [(str(n), t, 1, "", 0, 1, t)]) for n, t in enumerate(texts)]
        flat = spark.createDataFrame(rows, "n int, filename string, file_path string, total_pages int, language string, total_chunks long, document_chunks array<struct<id:string,text:string,page_number:int,section_title:string,chunk_index:int,total_chunks_in_page:int,text_hash:string>>")
        return flat.select(F.struct("filename", "file_path", "total_pages", "language", "total_chunks").alias("parent_document"), "document_chunks")

    folder = str(tmp_path)
    assert I.build_store(spark, folder, docs("x", "y"), "json") is None
    assert sorted(r.text for r in I.build_store(spark, folder, mode="vectors").collect()) == ["x", "y"]
    assert sorted(r.text for r in I.build_store(spark, folder, docs("y", "z")).collect()) == ["x", "y", "z"]
    assert sorted(r.text for r in I.build_store(spark, folder, docs("y"), rebuild=True).collect()) == ["y"]
    with pytest.raises(ValueError):
        I.build_store(spark, folder, mode="other")


def test_files_and_query_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pdf").write_bytes(b"12345")
    (tmp_path / "b.txt").write_text("first question\n\n  second 问题 \n")
    assert [(r.filename, r.bytes) for r in I.list_files(spark, str(tmp_path)).collect()] == [("a.pdf", 5)]
    assert [r["query"] for r in I.read_queries(spark, f"{tmp_path}/b.txt").orderBy("query_id").collect()] == ["first question", "second 问题"]


def test_chapters_replace_a_page_and_checks_find_punctuation(spark):
    pages = spark.createDataFrame([(1, 1, "page"), (1, 2, "kept")], "doc_id long, page_number int, text string")
    chapters = spark.createDataFrame([(1, 1, 2, "", "Title"), (1, 1, 1, "body", "T")], "doc_id long, page_number int, chapter_no int, content string, title string")
    assert sorted(map(tuple, L.with_chapters(pages, chapters).collect())) == [(1, 1, "body\nTitle"), (1, 2, "kept")]
    assert L.first_pages(pages, 1).count() == 1 and L.first_pages(pages, None).count() == 2
    assert [r.title for r in TI.punctuated(spark.createDataFrame([("a, b",), ("a b",)], "title string")).collect()] == ["a, b"]


def test_stream_ingest_over_batches_keeps_the_first_of_a_hash(spark, tmp_path):
    schema = "doc_id long, text string"
    long, other = "The same sentence stands here again and again. " * 3, "Another text that nobody else has written down. " * 3
    for n, rows in enumerate([[(1, long), (2, long)], [(3, long), (4, other)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.stream_ingest(source, f"{tmp_path}/store", f"{tmp_path}/state")
    found = spark.read.parquet(f"{tmp_path}/store").groupBy("text_hash").agg(F.count_distinct("doc_id").alias("docs")).collect()
    assert found and all(r.docs == 1 for r in found)
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/store").collect()} == {1, 4}


def test_predicates(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), (None, 5)], "t string, n int")
    assert df.where(R.predicate({"$or": [{"t": "a"}, {"$and": [{"t": {"$eq": "b"}}, {"n": {"$gte": 2, "$lte": 5}}]}]})).count() == 2


def test_dialogs(spark):
    m = spark.createDataFrame([(1, i, "user", "x" * (199 + i)) for i in range(12)], "conv_id long, turn long, role string, text string")
    context = D.dialog_context(m).first().context.split("\n")
    assert len(context) == 10 and max(map(len, context)) == len("- user: ") + 200
    more = D.append_exchange(m, spark.createDataFrame([(1, "q", "a"), (2, "q", "a")], "conv_id long, question string, answer string"))
    assert sorted((r.conv_id, r.turn, r.role) for r in more.where("text IN ('q', 'a')").collect()) == [(1, 12, "user"), (1, 13, "assistant"), (2, 0, "user"), (2, 1, "assistant")]
    changes = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (9, 1, "lost")], "conv_id long, changed_at long, title string")
    known, rejected = D.latest_titles(changes, m)
    assert [r.title for r in known.collect()] == ["new"] and rejected.count() == 1
    assert [r.title for r in D.dialog_list(m, known).collect()] == ["new"]


def test_windows_and_embeddings_against_plain_python(spark):
    """Spans cut from segments, and bucket counts, are those of a loop over the text."""
    import hashlib
    import random
    import re

    from corpusmill.functions import vectors as V
    from corpusmill.operators import chunks as C

    rng = random.Random(3)
    texts = ["", "a", "x" * 1200, ". " * 700, "né 😀. " * 400, None, *["".join(rng.choice("ab c.。é😀\n") for _ in range(rng.randrange(3000))) for _ in range(12)]]

    def spans(t):
        out, start = [], 0
        while start < len(t):
            end, w = start + 512, t[start : start + 512]
            stop = start + max(w.rfind("."), w.rfind("。"))
            if end < len(t) and stop > start + 256:
                end = stop + 1
            out.append((start, min(end, len(t))))
            start = end - 50 if end < len(t) else len(t)
        return out

    def vector(t):
        v = [0.0] * 64
        for w in re.findall("[a-z0-9']+", t.lower()):
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            v[h % 64] += 1.0 if h // 64 % 2 == 0 else -1.0
        return v

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", C.chunk_spans(F.col("t")).alias("s"), V.hash_embedding(F.col("t")).alias("v")).collect():
        t = texts[r.i]
        assert r.s == (None if t is None else spans(t)) or [tuple(x) for x in r.s] == spans(t)
        assert r.v == (None if t is None else vector(t))
