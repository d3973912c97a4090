"""Chunks: overlapping windows that end at a full stop where one is late enough, ids, hashes, parent records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

SIZE, OVERLAP = 512, 50
DOC = ["doc_id", "page_number"]


def _segments(text: Column, size: int) -> Column:
    """The text in parts of `size` characters: a window is then cut from two of them, however long the text is."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})"))


def _window(segments: Column, start: Column, length: Column, size: int) -> Column:
    """`length` characters, at most `size`, from `start`."""
    i = F.floor(start / size).cast("int")
    return F.substring(F.concat(F.coalesce(F.get(segments, i), F.lit("")), F.coalesce(F.get(segments, i + 1), F.lit(""))), (start % size + 1).cast("int"), length)


def _spans(segments: Column, n: Column, size: int, overlap: int) -> Column:
    def end_of(start: Column) -> Column:
        window = _window(segments, start, F.lit(size), size)
        back = F.least(*[F.coalesce(F.nullif(F.locate(stop, F.reverse(window)), F.lit(0)), F.lit(size + 1)) for stop in ("。", ".")])
        stop = start + F.least(n - start, F.lit(size)) - back  # of the last full stop; before start if there is none
        return F.when((start + size < n) & (stop > start + size // 2), stop + 1).otherwise(start + size)

    steps = F.sequence(F.lit(0), F.ceil(n / (size // 2 + 2 - overlap)).cast("int") + 1)
    none = F.array().cast("array<int>")

    def step(acc: Column, _: Column) -> Column:
        def go(end: Column) -> Column:
            return F.struct(F.when(end < n, end - overlap).otherwise(n).cast("int").alias("at"), F.concat(acc["ends"], F.array(F.least(end, n).cast("int"))).alias("ends"))

        return F.when(acc["at"] >= n, acc).otherwise(F.get(F.transform(F.array(end_of(acc["at"])), go), F.lit(0)))

    ends = F.aggregate(steps, F.struct(F.lit(0).cast("int").alias("at"), none.alias("ends")), step)["ends"]
    return F.transform(F.array(ends), lambda e: F.transform(e, lambda end, i: F.struct(F.when(i == 0, 0).otherwise(F.get(e, i - 1) - overlap).cast("int").alias("start"), end.alias("end"))))


def chunk_spans(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of (start, end), 0-based, of the windows of a text: a fold in the JVM, as many steps as the least advance needs."""
    bound = F.array(F.struct(_segments(text, size).alias("s"), F.length(text).alias("n")))
    return F.when(text.isNotNull(), F.get(F.transform(bound, lambda x: F.get(_spans(x["s"], x["n"], size, overlap), F.lit(0))), F.lit(0)))


def chunk_text(rows: DataFrame, least: int = 1, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Rows with a text -> a row a chunk with chunk_index, and text the stripped chunk of `least` characters or more; numbered after the drop."""
    others = [c for c in rows.columns if c != "text"]

    def cut(x: Column) -> Column:
        spans = F.get(_spans(x["s"], x["n"], size, overlap), F.lit(0))
        windows = F.transform(spans, lambda s: _window(x["s"], s["start"], s["end"] - s["start"], size))
        return F.filter(F.transform(windows, T.strip), lambda c: F.length(c) >= least)

    bound = F.array(F.struct(_segments(F.col("text"), size).alias("s"), F.length("text").alias("n")))
    kept = F.get(F.transform(bound, cut), F.lit(0))
    each = rows.where("text IS NOT NULL AND text <> ''").select(*others, kept.alias("all"))
    # outer, so that no filter on the array is inferred, for which each text would be cut three times
    return each.select(*others, F.size("all").alias("total_chunks_in_page"), F.posexplode_outer("all").alias("chunk_index", "text")).where("text IS NOT NULL")


def chunks(pages: DataFrame, sections: DataFrame, blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Page texts with their section, first block's box and file -> chunk records."""
    box = blocks.groupBy(*DOC).agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), "block_no").alias("box"))
    cut = chunk_text(pages).join(sections, DOC).join(box, DOC, "left").join(files.select("doc_id", "stem", "filename", "language"), "doc_id")
    return cut.select(
        F.format_string("%s_p%03d_c%03d", "stem", "page_number", "chunk_index").alias("id"), "doc_id", "page_number", "chunk_index", "total_chunks_in_page", "section_title", "text",
        text_hash(F.col("text")).alias("text_hash"), F.col("box.x0").alias("x0"), F.col("box.y0").alias("y0"), F.col("box.x1").alias("x1"), F.col("box.y1").alias("y1"), "filename", "language",
    )


def text_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 16)


def chunk_ids(cut: DataFrame, files: DataFrame) -> DataFrame:
    """Both id forms: by page and chunk, and by a running number in the document."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "chunk_index")) - 1
    return cut.join(files.select("doc_id", "stem"), "doc_id").select("doc_id", "page_number", "chunk_index", F.format_string("%s_p%03d_c%03d", "stem", "page_number", "chunk_index").alias("id"), F.format_string("%s_%06d", F.col("stem"), n).alias("running_id"))


def parent_documents(blocks: DataFrame, chunk_rows: DataFrame, files: DataFrame) -> DataFrame:
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page_number").cast("int").alias("total_pages"), F.min_by("language", F.struct("page_number", "block_no")).alias("language"))
    n = chunk_rows.groupBy("doc_id").agg(F.count("*").alias("total_chunks"))
    return pages.join(n, "doc_id", "left").join(files.select("doc_id", "filename", "file_path"), "doc_id").select("doc_id", "filename", "file_path", "language", "total_pages", F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"))


def content_hash(docs: DataFrame) -> DataFrame:
    """Content md5 with how many documents have it and the first of them."""
    own = docs.select("doc_id", F.md5("text").alias("hash"))
    groups = own.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return own.join(groups, "hash")
