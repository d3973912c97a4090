"""Inputs derived from the driver's tables by fixed rules: files, blocks, spans, words, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

PAGE_BLOCKS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language(lang):
    return F.when(lang == "en", "English").when(lang == "fr", "French").when(lang == "de", "German").otherwise("Spanish")


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the names of their files: doc_id, stem, filename, language, text."""
    stem = F.concat(F.array_join(T.first_words(F.col("text"), 3), " "), F.lit("_"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", stem.alias("stem"), language(F.col("lang")).alias("language"), "text")
    return docs.select("doc_id", "stem", F.concat("stem", F.lit(".pdf")).alias("filename"), "language", "text")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = named_documents(spark, sf_dir)
    return docs.select("doc_id", F.col("doc_id").alias("file_no"), "stem", "filename", F.concat(F.lit("data/source/"), "language", F.lit("/"), "filename").alias("file_path"), "language")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", language(F.col("lang")).alias("language"), F.posexplode_outer(F.split("text", r"[.,\n]+")).alias("block_no", "raw"))  # outer: no filter is inferred that splits each text again
    kept = docs.select("doc_id", "language", "block_no", F.trim("raw").alias("text")).where("text <> ''")
    shift = F.col("doc_id") + F.col("block_no")
    width = F.least(F.length("text") * F.lit(5.0), F.lit(540.0))
    slot = F.col("block_no") % PAGE_BLOCKS
    x0, y0 = F.when(shift % 7 == 0, 306 - width / 2).otherwise(36.0), (40 + slot * 24).cast("double")
    return kept.select(
        "doc_id", "language", (F.floor(F.col("block_no") / PAGE_BLOCKS) + 1).cast("int").alias("page_number"), "block_no", "text",
        x0.alias("x0"), y0.alias("y0"), (x0 + width).alias("x1"), (y0 + 12 + (shift % 4) * 4).cast("double").alias("y1"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of blocks as spans; every 11th block is no text."""
    w = blocks(spark, sf_dir).select("doc_id", "page_number", "block_no", F.col("x0").alias("bx"), "y0", "y1", T.words(F.col("text")).alias("w"))
    each = w.select("*", F.posexplode("w").alias("span_no", "word"))
    before = F.aggregate(F.slice("w", 1, F.col("span_no")), F.lit(0), lambda acc, x: acc + F.length(x) + 1)
    x0 = F.col("bx") + 5.0 * before
    return each.select("doc_id", "page_number", "block_no", F.lit(0).alias("line_no"), "span_no", F.when(F.col("block_no") % 11 == 10, 1).otherwise(0).alias("block_type"), F.concat("word", F.lit(" ")).alias("text"), x0.alias("x0"), "y0", (x0 + 5.0 * F.length("word")).alias("x1"), "y1")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    return s.select("doc_id", "page_number", (F.col("block_no") * 100_000 + F.col("span_no")).alias("word_no"), F.rtrim("text").alias("text"), "x0", (F.col("y0") + F.col("span_no") % 5).alias("y0"), "x1", "y1")


def short_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 25 = 0").select("doc_id", "text").join(files(spark, sf_dir).select("doc_id", "filename"), "doc_id")
    q = F.concat(
        F.array_join(T.first_words(F.col("text"), 6), " "), F.when(F.col("doc_id") % 50 == 0, " 1-3").otherwise(""),
        F.when(F.col("doc_id") % 75 == 0, F.concat(F.lit(" [仅在文件："), "filename", F.lit("]"))).otherwise(""),
    )
    return d.select(F.col("doc_id").alias("query_id"), q.alias("query"), F.lit(10).alias("top_k"))


def passage_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
