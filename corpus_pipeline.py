"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's docs. All but the last return the columns of documents; run() applies them to documents.

Defined results, for every stage: an empty table gives no rows; columns beyond those a stage reads pass through
all but the last, whatever their names; texts are read whole, however long. Null or empty texts are kept by
the first two stages, are one class of near-duplicates (one stays), have size 0 in the mix and pack to the id 0. Null
ids are ordered first and stay null. Repeated rows are scored and mixed alike, do not remove each other's lines,
and one of them stays as a near-duplicate. Ties between equal texts go to the least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import line_dedup, mixing, near_dedup, packing, toxicity
from corpusmill.llm.common import cut, documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below its cut. It is learned from labels outside the held-out quarter."""
    scored = toxicity.with_score(docs.select(F.struct("*").alias("_row"), "text"), toxicity.learn_outside(spark, sf_dir))
    return scored.where(F.col("score") < toxicity.CUT).select("_row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that stand earlier; documents of which nothing is left go, n_chars follows the text."""
    done = line_dedup.dedup(docs)
    removed, lines = (F.col(done.columns[-1])[c] for c in ("n_removed", "n_lines"))
    columns = [F.when(removed > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return done.where((removed == 0) | (removed < lines)).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence, with its token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: Order MinHash, the learned grammar and the tokenizer are beyond SQL; tests hold each stage against its definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
