"""Hits as rows and texts to show: previews, citations, context blocks, references; corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

UNKNOWN_FILE, UNKNOWN_SECTION = "未知文件", "未知章节"


def or_else(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def in_order(hits: DataFrame, line: Column, name: str, sep: str = "\n", most: int | None = None) -> DataFrame:
    """One text a query: its hits' lines by rank."""
    rows = hits if most is None else hits.where(F.col("rank") <= most)
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), sep).alias(name))


def format_hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", T.preview(F.col("text"), 800).alias("text_preview"), "section_title", F.col("page_number").cast("int").alias("page_number"), F.col("score").cast("double").alias("score"), T.basename(F.col("filename")).alias("pdf_filename"))


def context_text(hits: DataFrame, most: int = 10) -> DataFrame:
    line = F.concat(F.col("rank").cast("string"), F.lit(". 文件: "), "filename", F.lit(", 章节: "), "section_title", F.lit(", 页码: "), F.col("page_number").cast("string"), F.lit("\n"), T.preview(F.col("text"), 800), F.lit("\n"))
    return in_order(hits, line, "context", most=most)


def citations(hits: DataFrame) -> DataFrame:
    page = F.coalesce(F.nullif("page_number", F.lit(0)).cast("string"), F.lit("?"))
    percent = F.round(F.least(F.col("score") * 100, F.lit(100.0)), 1)
    return hits.select("query_id", "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), or_else("filename", "unknown"), F.lit(" | "), or_else("section_title", UNKNOWN_SECTION), F.lit(" | 页 "), page).alias("citation"), percent.alias("percent"))


def hits_text(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """The text a retrieval tool answers with; a fixed sentence for a query without hits."""
    page = F.coalesce(F.col("page_number").cast("string"), F.lit("?"))
    line = F.concat(
        F.lit("--- 相关文档 "), F.col("rank").cast("string"), F.lit(" (相似度:"), F.format_string("%.2f", F.round(F.col("score") + 1e-9, 2)), F.lit(") ---\n来源："), or_else("filename", UNKNOWN_FILE), F.lit(" / "),
        or_else("section_title", UNKNOWN_SECTION), F.lit("，第 "), page, F.lit(" 页\n内容："), T.strip(F.col("text")), F.lit("\n"),
    )
    body = in_order(hits, line, "body").join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")
    full = F.concat(F.lit("【检索结果】共找到 "), F.col("n").cast("string"), F.lit(" 条相关内容：\n\n"), "body", F.lit("\n【回答要求】\n请基于以上检索结果回答用户的问题。\n如果检索结果不足以回答问题，请明确说明。"))
    none = F.concat(F.lit("未检索到与「"), "query", F.lit("」相关的内容。"))
    return queries.select("query_id", "query").join(body, "query_id", "left").select("query_id", F.coalesce(full, none).alias("answer"))


def results_page(hits: DataFrame) -> DataFrame:
    """What a search returns: hits with the number of their query's hits."""
    return format_hits(hits).withColumn("count", F.count("*").over(Window.partitionBy("query_id")))


def references(hits: DataFrame, most: int = 5) -> DataFrame:
    return hits.where(F.col("rank") <= most).select("query_id", "rank", T.shortened(F.col("text"), 150).alias("text_preview"), "section_title", "page_number", "score", F.col("filename").alias("pdf_filename"))


def retrieved_docs(hits: DataFrame, most: int = 10) -> DataFrame:
    return hits.where(F.col("rank") <= most).select("query_id", "rank", or_else("filename", UNKNOWN_FILE).alias("pdf_filename"), or_else("section_title", UNKNOWN_SECTION).alias("section_title"), F.coalesce("page_number", F.lit(0)).alias("page_number"), F.coalesce("score", F.lit(0.0)).alias("score"), T.shortened(F.col("text"), 200).alias("text"), F.lit(True).alias("matched"))


def corpus_stats(chunks: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return chunks.agg(F.count("*").alias("total_chunks"), distinct("filename").alias("total_files"), F.array_sort(F.collect_set("language")).alias("languages"))


def answer_route(queries: DataFrame, hits: DataFrame, history: DataFrame) -> DataFrame:
    """retrieval where there are hits, history where only a dialog is known, else none."""
    h = hits.select("query_id").distinct().withColumn("has_hits", F.lit(True))
    d = history.select("query_id").distinct().withColumn("has_history", F.lit(True))
    route = F.when(F.col("has_hits"), "retrieval").when(F.col("has_history"), "history").otherwise("none")
    return queries.select("query_id").join(h, "query_id", "left").join(d, "query_id", "left").select("query_id", route.alias("route"))
