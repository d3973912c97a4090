"""Each stage against its definition on its own input, over a small table."""

import collections

import corpus_pipeline
from corpusmill.llm import near_dedup, toxicity
from tests.llm.test_operators import SCHEMA, WORD, corpus


def test_stages(spark, tmp_path):
    rows = corpus(seed=9, n=50)
    rows = [(d, (t + "\nyou idiot scum moron" if d % 33 == 0 and t else t), lang, s, n) for d, t, lang, s, n in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d % 33 == 0)) for d, *_ in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        ids = [r.doc_id for r in after]
        if name != "pack":
            assert docs.columns == [f.name for f in SCHEMA]
        if name == "toxicity":
            assert set(before) - set(ids) == {d for d in before if d % 33 == 0 and before[d].text}
        if name == "line_dedup":
            assert set(ids) <= set(before) and all(r.n_chars == len(r.text) for r in after if r.text != before[r.doc_id].text)
        if name == "near_dedup":
            texts = collections.Counter(before[d].text or "" for d in before)
            assert len(ids) == len(set(ids)) and {before[d].text or "" for d in ids} <= set(texts)
            words = {d: WORD.findall(before[d].text or "") for d in ids}
            for a in ids:
                for b in ids:
                    assert a == b or len(words[a]) < 5 or len(words[b]) < 5 or not near_dedup.similar(words[a], words[b])
        if name == "mix_sources":
            assert max(collections.Counter(ids).values()) <= 3 and set(ids) <= set(before)
        if name == "pack":
            assert set(ids) == set(before) and sum(r.length for r in after) == sum(r.doc_tokens for r in after if r.start == 0)
        before = {r.doc_id: r for r in after} if name != "pack" else before
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_writes_the_same_pieces(spark, tmp_path):
    rows = corpus(seed=11, n=20)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    runs = [sorted((r.doc_id, r.start, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and runs[0]
    assert toxicity.CUT == 0.3
