"""Titles and sections: candidates by shape, words and place; ranges; the section of each page."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# Words that mark titles, by language, and characters that no title has.
KEYWORDS = {
    "Chinese": ["序", "序言", "前言", "引言", "导言", "导读", "楔子", "后记", "跋", "附录", "参考文献", "索引", "致谢", "篇", "章", "节", "讲", "部分", "卷", "集", "编", "一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "壹", "贰", "叁", "肆", "伍", "陆", "柒", "捌", "玖", "拾", "第一", "第二", "第三", "概述", "总论", "绪论", "背景", "结论", "总结", "讨论"],
    "Japanese": ["はじめに", "序", "序文", "序章", "前言", "プロローグ", "あとがき", "後記", "結び", "エピローグ", "付録", "参考文献", "索引", "謝辞", "第", "章", "節", "部", "篇", "講", "パート", "一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "１", "２", "３", "４", "５", "６", "７", "８", "９", "１０", "概要", "総論", "緒論", "背景", "結論", "まとめ", "考察"],
    "English": ["Preface", "Foreword", "Introduction", "Prologue", "Abstract", "Executive Summary", "Epilogue", "Afterword", "Conclusion", "Appendix", "References", "Bibliography", "Index", "Acknowledgements", "Acknowledgments", "Chapter", "Part", "Section", "Lecture", "Volume", "Book", "Unit", "Module", "Article", "Overview", "Background", "Methods", "Results", "Discussion", "Summary"],
}
PUNCTUATION = list(".。!！?？…—―,，、;；:：·•・~〜～-–─━“”\"'‘’「」『』｢｣《》〈〉【】〔〕〖〗〘〙〚〛()[]{}<>（）［］｛｝＜＞*&@#%^+=_`|\\/§¶†‡〃※◇○●◎☆★□■△▲▽▼◆◦▫▪¤¦©®™°¥$€£¢₩₹〒")
PUNCTUATION_CLASS = "[" + "".join("\\" + c if re.match(r"[!-/:-@\[-`{-~]", c) else c for c in PUNCTUATION) + "]"
LIMITS = {"Chinese": 7, "Japanese": 8, "English": 7}
FIRST_PAGES = 10
NO_WIDTH = 612.0


def length_ok(text, doc_language):
    """By characters, but by words for texts without CJK characters or kana in English documents."""
    by_words = F.size(T.words(text)) <= LIMITS["English"]
    return F.when(text.rlike(T.CJK), F.length(text) <= LIMITS["Chinese"]).when(text.rlike(T.KANA), F.length(text) <= LIMITS["Japanese"]).when(doc_language == "English", by_words).otherwise(F.length(text) <= LIMITS["Chinese"])


def has_punctuation(text):
    """As by PUNCTUATION_CLASS, whose many members a regular expression tries one after the other at each character."""
    return F.translate(text, "".join(PUNCTUATION), "") != text


def title_candidates(blocks: DataFrame) -> DataFrame:
    """Blocks that may be titles: no punctuation, short, and centred or with a word of the document's language (its first page's).

    The cheap conditions come first: words and signs are looked for in short blocks alone.
    """
    blocks = blocks.withColumn("stripped", T.strip(F.col("text")))  # once, below the windows
    page, doc = Window.partitionBy("doc_id", "page_number"), Window.partitionBy("doc_id")
    width = F.coalesce(F.nullif(F.greatest(F.max("x1").over(page), F.lit(0.0)), F.lit(0.0)), F.lit(NO_WIDTH))
    first = F.min_by("language", F.struct("page_number", "block_no")).over(doc)
    seen = blocks.select("*", width.alias("width"), first.alias("doc_language"), F.dense_rank().over(doc.orderBy("page_number")).alias("page_pos"), F.max("page_number").over(doc).alias("last_page"))
    text = F.col("stripped")
    centre = (F.col("x0") + F.col("x1")) / 2
    keyword = F.lit(False)
    for language, ws in KEYWORDS.items():
        keyword = keyword | ((F.col("doc_language") == language) & text.rlike("|".join(map(re.escape, ws))))
    named = keyword | centre.between(F.col("width") * 0.4, F.col("width") * 0.6)
    return seen.where((text != "") & length_ok(text, F.col("doc_language")) & named & ~has_punctuation(text)).select("doc_id", "page_number", "block_no", text.alias("title"), "page_pos", "last_page")


def punctuated(found: DataFrame) -> DataFrame:
    """The titles that hold punctuation: none, as a last check."""
    return found.where(has_punctuation(F.col("title")))


def titles(candidates: DataFrame) -> DataFrame:
    """(doc_id, seq, title, start_page, last_page): the first candidate of each page if one is on the first pages;
    else all candidates, only repeated texts (once each) if any repeats."""
    doc = Window.partitionBy("doc_id")
    c = candidates.select(
        "*", F.max((F.col("page_pos") <= FIRST_PAGES).cast("int")).over(doc).alias("early"),
        F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("block_no")).alias("on_page"),
        F.count("*").over(Window.partitionBy("doc_id", "title")).alias("times"),
        F.row_number().over(Window.partitionBy("doc_id", "title").orderBy("page_number", "block_no")).alias("nth"),
    )
    c = c.withColumn("most", F.max("times").over(doc))
    late = (F.col("early") == 0) & ((F.col("most") == 1) | ((F.col("times") > 1) & (F.col("nth") == 1)))
    kept = c.where(((F.col("early") == 1) & (F.col("on_page") == 1)) | late)
    seq = F.row_number().over(doc.orderBy("page_number", "block_no"))
    return kept.select("doc_id", seq.alias("seq"), "title", F.col("page_number").alias("start_page"), "last_page")


def section_ranges(found: DataFrame) -> DataFrame:
    """Titles with end_page: the page before the next title, or the last page."""
    after = F.lead("start_page").over(Window.partitionBy("doc_id").orderBy("start_page", "seq"))
    return found.select("doc_id", "seq", "title", "start_page", F.coalesce(after - 1, F.col("last_page")).cast("int").alias("end_page"))


def page_sections(pages: DataFrame, ranges: DataFrame, default: str = "") -> DataFrame:
    """pages (doc_id, page_number) -> section_title: the last title that starts on the page or before it."""
    on_page = ranges.groupBy("doc_id", F.col("start_page").alias("page_number")).agg(F.max_by("title", "seq").alias("t"))
    upto = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    joined = pages.join(on_page, ["doc_id", "page_number"], "left")
    return joined.select("doc_id", "page_number", F.coalesce(F.last("t", ignorenulls=True).over(upto), F.lit(default)).alias("section_title"))


def doc_summary(sections: DataFrame) -> DataFrame:
    return sections.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_distinct(F.when(F.col("section_title") != "", F.col("section_title"))).alias("titles"))
