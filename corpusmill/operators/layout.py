"""Layout: spans, lines and words of pages to text blocks and page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

PAGE = ["doc_id", "page_number"]


def spans_to_lines(spans: DataFrame) -> DataFrame:
    """Spans of text blocks, left to right, joined without a separator; blank lines go."""
    line = spans.where("block_type = 0").groupBy(*PAGE, "block_no", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "span_no", "text"))), lambda s: s["text"]), "").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    return line.withColumn("text", T.strip(F.col("text"))).where("text <> ''")


def merge_paragraphs(lines: DataFrame, gap: float = 5.0) -> DataFrame:
    """Lines in order of y0 merge while the next begins less than `gap` under the one before; y1 is the last line's."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "block_no")
    marked = lines.withColumn("new", F.coalesce((F.col("y0") - F.lag("y1").over(order) >= gap).cast("int"), F.lit(1)))
    islands = marked.withColumn("island", F.sum("new").over(order))
    place = F.struct("y0", "block_no")
    return islands.groupBy(*PAGE, "island").agg(
        F.min("block_no").alias("block_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "block_no", "text"))), lambda s: s["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max_by("y1", place).alias("y1"),
    ).drop("island")


def words_to_lines(words: DataFrame, least: int = 5, gap: float = 5.0) -> DataFrame:
    """Words of pages with more than `least` of them; a new line where y0 differs from the word before by `gap` or more."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "word_no")
    counted = words.withColumn("n", F.count("*").over(Window.partitionBy(*PAGE))).where(F.col("n") > least)
    marked = counted.withColumn("new", F.coalesce((F.abs(F.col("y0") - F.lag("y0").over(order)) >= gap).cast("int"), F.lit(1)))
    lines = marked.withColumn("line_no", F.sum("new").over(order)).groupBy(*PAGE, "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "word_no", "text"))), lambda s: s["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    return lines.withColumn("line_no", F.col("line_no").cast("int")).where(T.strip(F.col("text")) != "")


def flip_blocks(rows: DataFrame, height: float) -> DataFrame:
    """Rows measured from the bottom: flipped, cleaned of NUL, and kept only on pages with a CJK or kana character."""
    clean = T.strip(F.translate("text", "\u0000", ""))
    flipped = rows.select(*PAGE, "block_no", clean.alias("text"), "x0", (height - F.col("y1")).alias("y0"), "x1", (height - F.col("y0")).alias("y1")).where("text <> ''")
    return flipped.withColumn("asian", F.max(F.col("text").rlike(T.CJK_OR_KANA)).over(Window.partitionBy(*PAGE))).where("asian").drop("asian")


def first_source(*sources: DataFrame) -> DataFrame:
    """Of block tables in order of preference, each page's blocks from the first that has any; `source` tells which."""
    columns = [*PAGE, "text", "x0", "y0", "x1", "y1"]
    union = None
    for i, s in enumerate(sources):
        one = s.select(*columns, F.lit(i).alias("source"))
        union = one if union is None else union.union(one)
    return union.withColumn("best", F.min("source").over(Window.partitionBy(*PAGE))).where("source = best").drop("best")


def clean_blocks_ja(blocks: DataFrame) -> DataFrame:
    """Line breaks inside a block go, page numbers low on the page and blocks over 200 high are dropped; blanks stay."""
    text = F.translate(T.strip(F.col("text")), "\n", "")
    number = F.col("text").rlike(r"^\p{Nd}{1,2}$") & (F.col("y1") > 500)
    return blocks.withColumn("text", text).where(~number & (F.col("y1") - F.col("y0") <= 200))


def first_pages(rows: DataFrame, most: int | None) -> DataFrame:
    """What stands on each document's first `most` pages; None is no limit."""
    return rows if most is None else rows.where(F.col("page_number") <= most)


def page_text(blocks: DataFrame, gap: float = 10.0) -> DataFrame:
    """Blocks by y0, a line break where the gap to the block before (blank ones count) exceeds `gap`, else a space."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "block_no")
    apart = blocks.withColumn("sep", F.when(F.col("y0") - F.lag("y1").over(order) > gap, "\n").otherwise(" "))
    kept = apart.where(T.filled(F.col("text")))
    page = kept.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y0", "block_no", "sep", "text"))).alias("b"))
    parts = F.transform("b", lambda s, i: F.concat(F.when(i == 0, "").otherwise(s["sep"]), s["text"]))
    return page.select(*PAGE, F.array_join(parts, "").alias("text"))


def with_chapters(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """Page text, replaced by the page's chapters (content, else title, one a line) where it has any."""
    own = chapters.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_no", F.coalesce(F.nullif("content", F.lit("")), "title").alias("t")))), lambda s: s["t"]), "\n").alias("own"))
    return pages.join(own, PAGE, "full").select(*PAGE, F.coalesce("own", "text").alias("text"))
