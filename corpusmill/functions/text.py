"""Column functions for text: white space, tokens, page ranges, file markers, scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[一-鿿]"
KANA = "[぀-ヿ]"
CJK_OR_KANA = "[一-鿿぀-ヿㇰ-ㇿ]"
#: What is removed before asking whether a title has anything left.
TITLE_FILLER = r"(?U)[\s\-\._，。,、：:\d一二三四五六七八九十百千零壹贰叁肆伍陆柒捌玖]"
PAGE_RANGE = r"[第]?\s*(\d+)\s*[-至到]\s*(\d+)\s*[页]?"
FILE_MARKER = r"\[仅在文件：(.+?)\]"


def strip(c: Column) -> Column:
    """Without outer white space, Unicode's included; texts without are not searched for it."""
    outer = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(outer.rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def filled(c: Column) -> Column:
    """Whether a text has more than white space: strip(c) != ''."""
    return c.rlike(r"(?U)\S")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def first_words(c: Column, n: int) -> Column:
    """The first n words, without splitting what follows them."""
    return words(F.regexp_extract(c, rf"(?U)^\s*+(?:\S++\s++){{0,{n - 1}}}\S*+", 0))


def tokens(c: Column, hint: Column | None = None) -> Column:
    """Characters for Chinese and Japanese (by hint or script), else runs of a-z, 0-9 and apostrophe; null has none."""
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    hinted = F.lower(F.coalesce(hint, F.lit(""))) if hint is not None else F.lit("")
    by_char = F.startswith(hinted, F.lit("ch")) | F.startswith(hinted, F.lit("ja")) | t.rlike(CJK) | t.rlike(KANA)
    chars = F.filter(F.split(t, ""), lambda x: strip(x) != "")
    return F.when(by_char, chars).otherwise(F.regexp_extract_all(t, F.lit(r"([a-z0-9']+)")))


def token_set(c: Column, hint: Column | None = None) -> Column:
    return F.array_sort(F.array_distinct(tokens(c, hint)))


def valid_section_title(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return t.rlike("[一-鿿A-Za-z]") & (F.length(F.regexp_replace(t, TITLE_FILLER, "")) > 0)


def page_range(c: Column) -> tuple[Column, Column]:
    """(first, last) page named in a query, null if none or not an INT."""
    return tuple(F.regexp_extract(c, PAGE_RANGE, k).try_cast("int") for k in (1, 2))


def file_filter(c: Column) -> tuple[Column, Column]:
    """(query without its file marker, file named by it or null)."""
    return F.rtrim(F.regexp_replace(c, r"\s*" + FILE_MARKER + r"\s*$", "")), F.nullif(F.regexp_extract(c, FILE_MARKER, 1), F.lit(""))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def preview(c: Column, n: int) -> Column:
    return F.translate(F.substring(F.coalesce(c, F.lit("")), 1, n), "\n", " ")


def shortened(c: Column, n: int) -> Column:
    """The first n characters, with ... if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def truncated(c: Column, n: int = 100, suffix: str = "...") -> Column:
    """At most n characters, suffix included."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - len(suffix)), F.lit(suffix)))


def extension(name: Column) -> Column:
    """Lower-case file extension; a dot file has none."""
    return F.lower(F.regexp_extract(name, r"[^./][^/]*\.([^./]*)$", 1))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(a / F.nullif(b, F.lit(0)))


def human_size(n: Column) -> Column:
    """Bytes with a unit of base 1024, two decimals at most; zero is 0B."""
    power = F.floor(F.log2(n.cast("double")) / 10).cast("int")
    value = F.round(n / F.pow(F.lit(1024.0), power), 2)
    names = F.array(*map(F.lit, "B KB MB GB TB PB EB ZB YB".split()))
    return F.when(n == 0, F.lit("0B")).otherwise(F.concat(value.cast("string"), F.lit(" "), F.get(names, power)))


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def jaccard(a: Column, b: Column) -> Column:
    """Of lower-case word sets; 1 if both are empty."""
    x, y = (F.array_distinct(words(F.lower(c))) for c in (a, b))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
