"""Each stage of the pipeline on odd rows: nulls, empty and long texts, repeated rows and ids, clashing columns, and no rows at all."""

import collections
import random

import pytest

import corpus_pipeline
from corpusmill.llm import packing

CLASHING = "score size copies rate target source_size n_lines n_removed key line h grp member token start length ids sequence_id offset doc_tokens _row _copies _salt _source text_hash".split()
TOXIC = "you are an idiot and a moron, you scum"


def odd_rows():
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))

    lines = [f"{prose(9)}." for _ in range(60)]
    rows = [(i, "\n".join(lines[5 * i : 5 * i + 5]), "en", "s", 9) for i in range(8)]
    rows += [(None, prose(60), None, None, None), (None, prose(70), "en", "s", 1), (None, None, None, None, None), (20, None, "en", "s", 0), (21, "", "en", "t", 0), (22, " \n\t ", "en", "t", 4)]
    rows += [(30, prose(40), "en", "t", 1), (30, prose(45), "de", "t", 1), (31, "one two", "fr", "u", 7), (-5, "é😀 ñ", "es", "", 4)]
    repeated = (40, prose(50), "en", "s", 3)
    return rows + [repeated] * 3 + [(50, "\n".join(prose(12) for _ in range(4000)), "en", "s", 1)], (60, TOXIC, "en", "s", 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows, toxic = odd_rows()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    wide = spark.createDataFrame([*rows, toxic], schema).selectExpr("*", *[f"'{i}' AS {c}" for i, c in enumerate(CLASHING)])
    wide.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(60, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet")


def counted(df):
    return collections.Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def test_odd_rows_pass_through_the_stages(spark, tables):
    folder, docs = tables
    stages = dict(corpus_pipeline.STAGES)
    clean = docs.where(f"text IS NULL OR text <> '{TOXIC}'")
    given = counted(clean)

    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns and counted(kept) == given

    lines = stages["line_dedup"](spark, clean, folder)
    assert lines.columns == docs.columns and counted(lines) == given  # equal rows do not remove each other's lines

    once = stages["near_dedup"](spark, clean, folder)
    left = counted(once)
    assert once.columns == docs.columns and set(left.values()) == {1}
    blank = {k for k in given if not k[1]}  # null and empty texts are one class; white space is a text
    assert set(given) - set(left) < blank and len(set(left) & blank) == 1

    mixed = stages["mix_sources"](spark, clean, folder)
    taken = counted(mixed)
    assert mixed.columns == docs.columns and set(taken) <= set(given) and all(n <= 3 * given[k] for k, n in taken.items())
    assert counted(stages["mix_sources"](spark, clean, folder)) == taken

    pieces = stages["pack"](spark, clean, folder).collect()
    assert all(0 < p.length and p.offset + p.length <= packing.LENGTH for p in pieces)
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert collections.Counter(p.doc_id for p in pieces if p.start == 0) == collections.Counter(k[0] for k in given.elements())
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length


def test_stages_without_rows(spark, tables):
    folder, docs = tables
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0 and (name == "pack" or out.columns == docs.columns), name
