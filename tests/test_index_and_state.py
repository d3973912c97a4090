"""Masked and approximate search, prefix joins, kept tables, the dialog log, block files and streamed state, against plain Python."""

import json
import random
import re
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import dialog_log as DL
from corpusmill.operators import ingest as I
from corpusmill.operators import match as R
from corpusmill.operators import pair_model as PM
from corpusmill.operators import reuse as U
from corpusmill.operators import search as S
from corpusmill.operators import segment as SG
from corpusmill.operators import vector_index as VI
from corpusmill.sources import block_json
from corpusmill.streaming import streams

# Search in scopes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scoped_rows(spark, rng):
    def unit():
        v = np.array([rng.randrange(-2, 3) for _ in range(4)], float)
        return (v / (np.linalg.norm(v) or 1)).tolist()

    q = [(i, unit(), None if i % 3 else rng.randrange(6), None if i % 3 or i % 9 == 6 else rng.randrange(9)) for i in range(40)]
    files = ["hot"] * 60 + [f"f{i}" for i in range(20)]
    items = [(f"i{n}", unit(), rng.choice(files), rng.choice(["t1", "t2", "", None]), rng.randrange(8)) for n in range(500)]
    scopes = {(i, ("file", rng.choice(files))) for i in range(38) for _ in range(3)} | {(i, ("title", rng.choice(["t1", "t2", "none"]))) for i in range(0, 38, 4)}
    return q, items, scopes


def plain_hits(q, items, allowed, k):
    out = []
    for query, v, first, last in q:
        own = [(-(round(float(np.dot(v, u)), 6) + 0.0), i) for i, u, f, t, p in items if allowed(query, f, t) and (first is None or (last is not None and first <= p <= last))]
        out += [(query, i, -s, n + 1) for n, (s, i) in enumerate(sorted(own)[:k])]
    return sorted(out)


@pytest.mark.parametrize("many", [False, True])
def test_hits_in_scopes_are_those_of_all_pairs(spark, monkeypatch, many):
    q, items, scopes = scoped_rows(spark, random.Random(4))
    if many:
        for name, value in {"FEW_QUERIES": 3, "CELL_QUERIES": 7, "CELL_ITEMS": 50, "QUERY_BLOCK": 4}.items():
            monkeypatch.setattr(S, name, value)
    queries = spark.createDataFrame(q, "query_id long, q_vector array<double>, first_page int, last_page int")
    rows = spark.createDataFrame([*items, ("null", None, "hot", "t1", 1), ("empty", [], "hot", "t1", 1)], "id string, vector array<double>, filename string, section_title string, page_number int")
    asked = spark.createDataFrame([(i, f"{kind}\0{value}") for i, (kind, value) in scopes] * 2, "query_id long, scope string")
    got = S.masked_topk(queries, S.chunk_scopes(rows), asked, 5, ranged=True)
    assert sorted(tuple(r) for r in got.collect()) == plain_hits(q, items, lambda i, f, t: (i, ("file", f)) in scopes or (i, ("title", t)) in scopes, 5)
    assert S.masked_topk(queries, S.chunk_scopes(rows), asked.limit(0), 5).count() == 0 and S.masked_topk(queries.limit(0), S.chunk_scopes(rows), asked, 5).count() == 0


def test_no_row_has_two_vectors_and_page_ranges_need_few_buckets(spark):
    q, items, scopes = scoped_rows(spark, random.Random(5))
    q = [(i, v, 2, 2_000_000_000 if i % 2 else 4) for i, v, _, _ in q]
    queries = spark.createDataFrame(q, "query_id long, q_vector array<double>, first_page int, last_page int")
    rows = spark.createDataFrame(items, "id string, vector array<double>, filename string, section_title string, page_number int")
    buckets, paged = S.page_scopes(queries, rows)
    assert buckets.count() <= 64 * len(q)
    got = S.masked_topk(queries, paged, buckets, 5, ranged=True)
    assert re.sub(r"#\d+L?", "", re.search(r"MapInArrow run\(([^)]*)\)", plan(got))[1]) == "id, vector, page, scope, asking"
    assert sorted(tuple(r) for r in got.collect()) == plain_hits(q, items, lambda *_: True, 5)


def test_an_item_of_many_scopes_is_one_hit(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q_vector array<double>")
    rows = spark.createDataFrame([(f"i{n}", [1.0, float(-n)]) for n in range(6)], "id string, vector array<double>")
    many = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("s"), i.cast("string")))
    asked = spark.createDataFrame([(1, f"s{i}") for i in range(1, 21)], "query_id long, scope string")
    hits = S.masked_topk(queries, rows.withColumn("scopes", many), asked, 4).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in hits] == [("i0", 1), ("i1", 2), ("i2", 3), ("i3", 4)]


def test_pairs_are_scopes_too(spark):
    q, items, _ = scoped_rows(spark, random.Random(6))
    pairs = {(i % 40, f"i{i * 7 % 500}") for i in range(300)}
    q = [(i, v, None, None) for i, v, _, _ in q]
    queries = spark.createDataFrame([r[:2] for r in q], "query_id long, q_vector array<double>")
    rows = spark.createDataFrame([r[:2] for r in items], "id string, vector array<double>")
    got = S.filtered_topk(queries, rows, spark.createDataFrame(list(pairs), "query_id long, id string"), 4).collect()
    want = [h for i, v, *_ in q for h in plain_hits([(i, v, None, None)], [r for r in items if (i, r[0]) in pairs], lambda *_: True, 4)]
    assert sorted(map(tuple, got)) == sorted(want)


# Inverted file


def vectors(spark, n, dims=8, clusters=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    v = centres[rng.integers(clusters, size=n)] + 0.3 * rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(f"v{i}", x.tolist()) for i, x in enumerate(v)], "id string, vector array<double>")


@pytest.mark.parametrize("many", [False, True])
def test_index_finds_nine_of_ten_and_all_cells_find_all(spark, tmp_path, monkeypatch, many):
    items = vectors(spark, 3000).union(spark.createDataFrame([("none", None), ("empty", []), ("zero", [0.0] * 8)], "id string, vector array<double>"))
    queries = items.where("id LIKE 'v%7'").select(F.substring("id", 2, 9).cast("long").alias("query_id"), F.col("vector").alias("q_vector"))
    queries = queries.union(spark.createDataFrame([(-1, None), (-2, [])], "query_id long, q_vector array<double>"))
    half = F.xxhash64("id") % 2 == 0
    VI.build_index(items.where(half), str(tmp_path), cells=24)
    VI.append_index(items.where(~half), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/items").count() == 3001
    want = {tuple(r) for r in S.vector_topk(queries, items, 10).collect()}
    if many:
        monkeypatch.setattr(VI, "FEW_QUERIES", 5)
        monkeypatch.setattr(S, "CELL_QUERIES", 40)
        monkeypatch.setattr(S, "CELL_ITEMS", 60)
    found = VI.search_index(queries, str(tmp_path), 10, probes=4)
    assert len({tuple(r)[:2] for r in found.collect()} & {r[:2] for r in want}) >= 0.9 * len(want)
    assert {tuple(r) for r in VI.search_index(queries, str(tmp_path), 10, probes=99).collect()} == want


def test_only_probed_cells_are_read(spark, tmp_path):
    items = vectors(spark, 500)
    VI.build_index(items, str(tmp_path), cells=10)
    one = VI.search_index(items.limit(1).select(F.lit(1).alias("query_id"), F.col("vector").alias("q_vector")), str(tmp_path), 3, probes=1)
    assert re.search(r"PartitionFilters: \[isnotnull\(cell#\d+\), \(cell#\d+ = ", plan(one)) and one.count() == 3
    assert len(VI.read_centroids(spark, str(tmp_path))) == 10


def test_index_of_nothing_of_one_and_of_equal_vectors(spark, tmp_path):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q_vector array<double>")
    schema = "id string, vector array<double>"
    for n, rows in enumerate([[], [("a", None)], [("a", [1.0, 0.0])], [(f"a{i}", [0.6, 0.8]) for i in range(50)], [("z", [0.0, 0.0])]]):
        VI.build_index(spark.createDataFrame(rows, schema), f"{tmp_path}/{n}")
        hits = VI.search_index(q, f"{tmp_path}/{n}", 3).collect()
        assert len(hits) == min(3, len(rows) if n > 1 else 0)


# Prefix join


def test_prefix_join_gives_the_overlaps_over_the_threshold(spark, monkeypatch):
    rng = random.Random(2)
    words = ["the", "a"] * 30 + [f"w{i}" for i in range(40)]
    qs = [(i, sorted({rng.choice(words) for _ in range(rng.randrange(9))})) for i in range(60)] + [(100, ["the"]), (101, ["unseen", "w1"]), (102, [])]
    ds = [(f"d{i}", sorted({rng.choice(words) for _ in range(rng.randrange(12))})) for i in range(200)]
    q = spark.createDataFrame(qs, "query_id long, q_tokens array<string>")
    d = spark.createDataFrame(ds, "name string, tokens array<string>")
    monkeypatch.setattr(R, "HOT_ITEMS", 20)
    for threshold in (0.2, 0.5, 0.7, 1.0):
        want = {(i, n, len({*a} & {*b}) / len(a)) for i, a in qs for n, b in ds if a and len({*a} & {*b}) / len(a) >= threshold}
        got = [tuple(r) for r in R.overlapping(q, d, ["name"], threshold).collect()]
        assert len(got) == len(want) and {*got} == want
    with pytest.raises(ValueError):
        R.overlapping(q, d, ["name"], 0)


def test_a_word_that_all_share_pairs_nothing_by_itself(spark):
    q = spark.createDataFrame([(i, ["the", f"x{i}", f"y{i}"]) for i in range(50)], "query_id long, q_tokens array<string>")
    d = spark.createDataFrame([(f"d{i}", ["the", f"z{i}"]) for i in range(400)], "name string, tokens array<string>")
    counts = d.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("times"))
    assert R._rare_prefix(q, counts, 0.5).where("token = 'the'").count() == 0
    assert R.overlapping(q, d, ["name"]).count() == 0 and R.token_overlap(q, d, ["name"]).count() == 50 * 400


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT_ITEMS", 10)
    few = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(10)], "query_id long, k string")
    many = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 10}") for i in range(300)], "id long, k string")
    got = R.dealt_join(few, many, "k", ["id"])
    assert sorted(map(tuple, got.select("query_id", "id").collect())) == sorted(map(tuple, few.join(many, "k").select("query_id", "id").collect()))


# Kept tables


def test_indexed_ingest_reads_its_buckets_and_equals_the_plain_one(spark, tmp_path):
    store, index = f"{tmp_path}/store", f"{tmp_path}/index"
    schema = "doc_id long, chunk_index int, text_hash string"
    rng = random.Random(1)
    seen, want = set(), []
    for batch in range(3):
        rows = [(batch * 10 + i, n, rng.choice(["", None, *[f"h{j}" for j in range(30)]])) for i in range(10) for n in range(4)]
        first = {}
        for doc, _, h in rows:
            first.setdefault(h, doc)
        want += [r for r in rows if not r[2] or (r[2] not in seen and first[r[2]] == r[0])]
        seen |= {r[2] for r in rows}
        n = U.ingest_with_index(spark.createDataFrame(rows, schema), store, index)
        assert n == len([r for r in want if r[0] // 10 == batch])
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, spark.read.parquet(store).select("doc_id", "chunk_index", "text_hash").collect()), key=key) == sorted(want, key=key)
    one = U.matching_buckets(spark, index, spark.createDataFrame([(1, 1, "h3")], schema), "text_hash", {"text_hash": "string"})
    assert "PartitionFilters: [isnotnull(bucket" in plan(one) and len(one.inputFiles()) <= spark.read.parquet(index).count()
    before = {r.text_hash for r in spark.read.parquet(index).collect()}
    U.rebuild_index(spark, store, index)
    assert {r.text_hash for r in spark.read.parquet(index).collect()} == before == seen - {"", None}


def test_a_second_run_encodes_nothing(spark, tmp_path):
    def encode(rows):
        return I.embed_text(rows).withColumn("vector", F.when(F.col("text") != "refused", F.col("vector")))

    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c")], "id long, text string")
    first, counts = U.encode_cached(rows, str(tmp_path), encode)
    assert counts == {"texts": 3, "hits": 0, "misses": 3}
    again, counts = U.encode_cached(rows.union(spark.createDataFrame([(6, "new")], rows.schema)), str(tmp_path), encode)
    assert counts == {"texts": 4, "hits": 3, "misses": 1}
    want = {r.id: r.vector for r in I.embed_text(rows).collect()}
    assert {r.id: r.vector for r in first.collect()} == want and want[3] is None
    assert {r.id: r.vector for r in again.where("id < 6").collect()} == want
    assert U.encode_cached(rows, str(tmp_path), encode)[1] == {"texts": 3, "hits": 3, "misses": 0}
    empty, counts = U.encode_cached(rows.where("id = 3"), f"{tmp_path}/none", encode)
    assert counts == {"texts": 0, "hits": 0, "misses": 0} and empty.first().vector is None


def test_run_totals(spark, tmp_path):
    files = spark.createDataFrame([("a", "[1,2]"), ("b", "{"), ("c", "[3]"), ("d", "[]")], "file_path string, content string")
    parse = lambda df: df.select("file_path", F.transform(F.from_json("content", "array<int>"), lambda x: F.struct(x.alias("n"))).alias("rows"))
    totals = U.counted_run(files, files.where("file_path = 'c'"), parse, str(tmp_path / "s"))
    assert totals == {"files": 4, "skipped": 1, "failed": 1, "processed": 2, "rows": 2}
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s")).collect())) == [("a", 1), ("a", 2)]
    assert U.counted_run(files, files, parse, str(tmp_path / "s")) == {"files": 4, "skipped": 4, "failed": 0, "processed": 0, "rows": 0}
    assert U.counted_run(files.limit(0), files, parse, str(tmp_path / "s")) == {"files": 0, "skipped": 0, "failed": 0, "processed": 0, "rows": 0}


def test_metadata_values_as_text(spark):
    df = spark.range(1).select(I.json_values({"a": F.lit(1), "b": F.lit("x\"y"), "c": F.array(F.lit(1), F.lit(2)), "d": F.lit(None), "e": F.lit(True), "f": F.struct(F.lit("v").alias("k"))}).alias("m"))
    assert df.first().m == {"a": "1", "b": 'x"y', "c": "[1,2]", "e": "true", "f": '{"k":"v"}'}


# Dialog log


def plain_log(batches):
    """batches of (seq, at, kind, conv, turn, role, text) -> conv -> title, created, updated, messages."""
    state = {}
    for batch in batches:
        for _, at, kind, conv, turn, role, text in sorted(batch, key=lambda e: e[0]):
            if kind == "delete":
                state.pop(conv, None)
                continue
            d = state.setdefault(conv, {"title": f"对话 {conv[:8]}", "times": [], "messages": []})
            d["times"].append(at)
            if kind == "title":
                d["title"] = text
            elif kind == "message":
                d["messages"].append((turn, role, text))
    return {(c, d["title"], min(d["times"]), max(d["times"]), len(d["messages"]), max((m[0] for m in d["messages"]), default=None)) for c, d in state.items()}


def test_log_view_and_compaction_agree_with_a_replay(spark, tmp_path):
    rng, path, batches, clock = random.Random(7), str(tmp_path), [], 0
    for b in range(6):
        events = []
        for seq in range(25):
            clock += 1
            kind = rng.choice(["message"] * 6 + ["title", "open", "delete"])
            events.append((seq, datetime(2024, 1, 1 + clock // 60 % 28, 0, clock % 60), kind, f"conv-{rng.randrange(8)}", clock if kind == "message" else None, "user" if kind == "message" else None, f"x{clock}" if kind in ("message", "title") else None))
        batches.append(events)
        DL.append_events(spark.createDataFrame(events, DL.EVENT), path, b)
        DL.append_events(spark.createDataFrame(events, DL.EVENT), path, b)  # a repeated attempt
        assert {tuple(r) for r in DL.dialog_view(DL.log_events(spark, path)).collect()} == plain_log(batches)
        if b in (1, 3):
            before = DL.log_events(spark, path)
            n = before.count()
            DL.compact(spark, path, b)
            assert before.count() == n  # who read before still sees its state
            assert {tuple(r) for r in DL.dialog_view(DL.log_events(spark, path)).collect()} == plain_log(batches)
    later = DL.log_events(spark, path)
    assert "PartitionFilters: [isnotnull(batch" in plan(later)
    # a compaction that stopped before it was entered changes nothing
    spark.range(3).write.parquet(f"{path}/snapshot-5")
    assert {tuple(r) for r in DL.dialog_view(DL.log_events(spark, path)).collect()} == plain_log(batches)
    DL.compact(spark, path, 5)
    assert {tuple(r) for r in DL.dialog_view(DL.log_events(spark, path)).collect()} == plain_log(batches)


def test_the_last_deletion_opens_a_new_dialog(spark, tmp_path):
    at, path = datetime(2024, 1, 1), str(tmp_path)
    assert DL.dialog_view(DL.log_events(spark, path)).count() == 0
    DL.append_events(DL.exchange_events(spark.createDataFrame([("a", "q", "r"), ("b", "q2", "r2")], "conv_id string, question string, answer string"), DL.log_events(spark, path), at, 0), path, 0)
    for batch, gone in enumerate((["a", "unknown"], ["b"]), 1):
        ids = spark.createDataFrame([(g,) for g in gone], "conv_id string")
        DL.append_events(DL.deletion_events(spark, DL.log_events(spark, path), ids, at, 0, "fresh-dialog"), path, batch)
    found = DL.dialog_view(DL.log_events(spark, path)).collect()
    assert [(r.conv_id, r.title, r.message_count, r.last_turn) for r in found] == [("fresh-dialog", "对话 fresh-di", 0, None)]
    DL.append_events(DL.exchange_events(spark.createDataFrame([("fresh-dialog", "q", "a"), ("fresh-dialog2", "x", "y")], "conv_id string, question string, answer string"), DL.log_events(spark, path), at, 0), path, 3)
    asked = spark.createDataFrame([("fresh-dialog",), ("a",)], "conv_id string")
    assert {r.conv_id: (r.known, r.messages and [m.text for m in r.messages]) for r in DL.histories(asked, DL.log_events(spark, path)).collect()} == {"fresh-dialog": (True, ["q", "a"]), "a": (False, None)}


# Files of blocks


def write_docs(folder, name, *docs, lines=True):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_text("\n".join(json.dumps(d) if isinstance(d, dict) else d for d in docs) if lines else json.dumps(docs[0], indent=1))


def doc(name, *texts):
    return {"file": name, "language": "English", "pages": [{"page_number": 1, "blocks": [{"text": t, "bbox": [0, n, 1, n + 1]} for n, t in enumerate(texts)]}]}


def test_block_files(spark, tmp_path):
    block_json.register(spark)
    read = lambda **o: spark.read.format("block_json").options(**o).load(str(tmp_path / "in"))
    assert read().count() == 0  # no folder
    write_docs(tmp_path / "in", "a.json", doc("a", "one", "two"), "{broken", '{"pages": 3}', "[]", doc("b", "three"))
    write_docs(tmp_path / "in" / "sub", "c.json", doc("c", "four"), lines=False)
    bad = doc("d", "x")
    bad["pages"][0]["blocks"] += [{"text": "no box"}, {"text": None, "bbox": [0, 0, 1, 1]}, {"text": "y", "bbox": [0, 0, 1, "1"]}]
    write_docs(tmp_path / "in", "d.json", bad)
    write_docs(tmp_path / "in", "e.txt", doc("e", "not asked for"))
    (tmp_path / "in" / "_f.json").write_text("hidden")
    got = read(partition_bytes=1)
    assert got.rdd.getNumPartitions() == 3
    assert sorted((r.relative_path, r.file, r.block_no, r.text, r.y1) for r in got.collect()) == [("a.json", "a", 0, "one", 1.0), ("a.json", "a", 1, "two", 2.0), ("a.json", "b", 0, "three", 1.0), ("d.json", "d", 0, "x", 1.0), ("sub/c.json", "c", 0, "four", 1.0)]
    assert {r.bytes for r in got.where("relative_path = 'd.json'").collect()} == {(tmp_path / "in" / "d.json").stat().st_size}
    assert read(pattern="*.txt").count() == 1


def test_block_files_as_a_stream(spark, tmp_path):
    block_json.register(spark)
    source, sink = tmp_path / "in", str(tmp_path / "out")

    def run():
        rows = spark.readStream.format("block_json").load(str(source))
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(sink).awaitTermination()
        return sorted(r.text for r in spark.read.parquet(sink).collect())

    for n in range(3):
        write_docs(source, f"{n}.json", doc(str(n), f"t{n}"))
    assert run() == ["t0", "t1", "t2"]
    write_docs(source, "9.json", doc("9", "t9"))
    assert run() == ["t0", "t1", "t2", "t9"]


def test_a_missing_folder_has_no_files(spark, tmp_path):
    assert I.list_files(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "a.pdf").write_bytes(b"123")
    assert [(r.filename, r.relative_path, r.bytes) for r in I.list_files(spark, f"{tmp_path}/x").collect()] == [("a.pdf", "y/a.pdf", 3)]


# Streamed state


def test_last_messages_over_three_batches(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    kept = defaultdict(list)
    for batch in range(3):
        rows = [(c, batch * 5 + i, "user", f"c{c} t{batch * 5 + i} " + "x" * 300) for c in range(1 + batch) for i in range(5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for c, *rest in rows:
            kept[c].append(rest)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.stream_contexts(source, f"{tmp_path}/out", f"{tmp_path}/state", last=7)
    got = {r.conv_id: r.context for r in streams.current_contexts(spark, f"{tmp_path}/out").collect()}
    assert got == {c: "\n".join(f"- {role}: {text[:200]}" for _, role, text in sorted(rows)[-7:]) for c, rows in kept.items()}
    assert spark.conf.get(streams.STATE_STORE, "") != streams.ROCKSDB
    # later messages go on from the kept state
    spark.createDataFrame([(0, 99, "assistant", "last")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    streams.stream_contexts(source, f"{tmp_path}/out", f"{tmp_path}/state", last=7)
    got = {r.conv_id: r.context for r in streams.current_contexts(spark, f"{tmp_path}/out").collect()}
    assert got[0].split("\n")[-1] == "- assistant: last" and len(got[0].split("\n")) == 7


def test_streamed_build_over_two_batches_has_each_hash_once(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path)
    block_json.register(spark)

    def run():
        rows = spark.readStream.format("block_json").load(str(source)).withColumns({"stem": F.col("file"), "filename": F.col("file"), "doc_id": F.col("file").cast("long")})
        streams.stream_build(rows.drop("relative_path", "bytes", "file"), f"{folder}/store", f"{folder}/index", f"{folder}/state")
        return sorted((r.doc_id, r.section_title, r.text) for r in spark.read.parquet(f"{folder}/store").collect())

    write_docs(source, "a.json", doc("1", "Chapter 1", "the first body"), doc("2", "other words"))
    assert run() == [(1, "Chapter 1", "Chapter 1 the first body"), (2, "other words", "other words")]
    write_docs(source, "b.json", doc("3", "other words"), doc("4", "new words"))
    assert [r[0] for r in run()] == [1, 2, 4]


# Pairs and words


def test_pairs_are_cut_to_their_length(spark):
    def plain(q, t, most):
        while len(q) + len(t) > most:
            (q if len(q) > len(t) else t).pop()
        return " ".join(q), " ".join(t)

    rows = [(f"q{a} " * a, f"t{b} " * b) for a in range(8) for b in range(8)]
    df = spark.createDataFrame([(q.strip(), t.strip()) for q, t in rows], "q string, t string")
    for most in (0, 1, 5, 6, 11):
        for r in df.select("q", "t", *[c.alias(n) for c, n in zip(S.pair_within(F.col("q"), F.col("t"), most), ("cq", "ct"))]).collect():
            assert (r.cq, r.ct) == plain(r.q.split(), r.t.split(), most)


def test_a_trained_scorer_puts_the_source_first(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    chunks = I.embed_text(spark.createDataFrame([(f"c{i}", " ".join(rng.choice(words) for _ in range(60))) for i in range(300)] + [("short", "a b"), ("blank", "")], "id string, text string")).persist()
    pairs = PM.training_pairs(chunks, near=8).persist()
    assert pairs.where("label = 1").count() == 300 and pairs.where("label = 0").groupBy("query_id").count().agg(F.min("count")).first()[0] >= 8
    weights = PM.fit(pairs.where("pmod(query_id, 2) = 0"))
    held_out = pairs.where("pmod(query_id, 2) = 1")

    def first(score):
        ranked = held_out.withColumn("r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc(score), "label")))
        return ranked.where("label = 1").agg(F.avg((F.col("r") == 1).cast("double"))).first()[0]

    assert first(PM.pair_score(weights)) > max(0.9, first(F.col("score")))
    assert "Python" not in plan(S.rerank(held_out, 3, PM.pair_score(weights))).split("InMemoryRelation")[0]


def test_paths_are_the_best_of_all(spark):
    rng = random.Random(0)
    for _ in range(60):
        weights = {"".join(rng.choice("天地人") for _ in range(rng.randrange(1, 4))): -float(rng.randrange(1, 9)) for _ in range(rng.randrange(1, 9))}
        run = "".join(rng.choice("天地人") for _ in range(rng.randrange(1, 9)))

        def total(words):
            return sum(weights.get(w, -12.0 if len(w) == 1 else -1e9) for w in words)

        cuts = [[run[a:b] for a, b in zip([0, *c], [*c, len(run)])] for m in range(1 << (len(run) - 1)) for c in [[i + 1 for i in range(len(run) - 1) if m >> i & 1]]]
        got = SG.best_path(run, weights, 3, -12.0)
        assert "".join(got) == run and abs(total(got) - max(map(total, cuts))) < 1e-9


def test_words_are_learned_from_unspaced_text(spark):
    rng = random.Random(1)
    signs = [chr(0x4E00 + i) for i in range(60)]
    known = ["".join(rng.sample(signs, rng.choice([1, 2, 2, 3, 4]))) for _ in range(80)]
    said = [[rng.choice(known) for _ in range(30)] for _ in range(400)]
    df = spark.createDataFrame([("".join(ws) + " Latin, don't",) for ws in said] + [(None,), ("",)], "text string")
    weights = SG.word_weights(SG.learn_words(df, cohesion=5.0))  # sixty signs meet often by chance
    got = [r[0] for r in df.select(SG.segmented(F.col("text"), weights)).collect()]
    assert got[-2:] == [[], []] and all(g[-2:] == ["latin", "don't"] for g in got[:-2])

    def ends(ws):
        return {sum(map(len, ws[: i + 1])) for i in range(len(ws))}

    pairs = [(ends(w), ends(g[:-2])) for w, g in zip(said, got)]
    both, want, found = (sum(len(x) for x in xs) for xs in ([a & b for a, b in pairs], [a for a, _ in pairs], [b for _, b in pairs]))
    assert both / want > 0.9 and both / found > 0.9
    assert SG.word_weights(SG.learn_words(df.limit(0))) == {}
    assert spark.range(1).select(SG.segmented(F.lit("天a地"), {})).first()[0] == ["天", "a", "地"]


def test_folders_must_be_shared_on_a_cluster(spark, monkeypatch):
    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        streams.shared_folder(Far)


def test_tokens_of_names(spark):
    assert spark.range(1).select(T.token_set(F.lit("It's a It's b"))).first()[0] == ["a", "b", "it's"]
