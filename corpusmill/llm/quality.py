"""Quality rules by distribution divergence (operator 10): DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 3-word windows. A document that passes them
is then compared with language references: the Jensen-Shannon distance (base 2, 0 to 1) of its
character-class histogram, and of its common-word histogram, to the nearest reference must not exceed a
limit that allows for the length; each comparison has a minimum length below which it is not made. A reference is the mean
histogram of all documents of one language that pass the base rules.

3-word windows are compared by a 64-bit hash of their words within one document.

Defined results: null or blank text has no words and fails the base rules; a language outside
COMMON_WORDS, or null, adds to no reference but is judged like all others; with no reference at all
(an empty table) the base rules alone decide; repeated rows each get their result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, documents, words

#: Frequent function words of each reference language.
COMMON_WORDS = {
    "en": "the of and to in is that for it as was with be by on are this at an or from".split(),
    "de": "der die das und in zu den von ist mit für auf im dem nicht ein eine als auch es".split(),
    "fr": "le la les de des et en un une du que pour dans est il sur par ce au qui".split(),
    "es": "el la los las de que y en un una por con para del se no es al lo su".split(),
}
LISTED = sorted({w for ws in COMMON_WORDS.values() for w in ws})
SYMBOLS = "[#*$%&|<>]"
CHAR_CLASSES = ("upper", "other_letter", "digit", "space", "punctuation", "symbol", "other")

MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of words
MIN_WORDS_FOR_CLASSES = 50
MIN_WORDS_FOR_COMMON = 100
#: (base, scale): a histogram of n words may lie sqrt(base^2 + scale / n) from the nearest reference; the second part is what chance alone does to short texts.
CLASS_LIMIT = (0.12, 5.0)
COMMON_LIMIT = (0.10, 14.0)


def _repeat_words(windows: Column, ordered: Column) -> Column:
    """Words in windows that occur twice or more; `ordered` is `windows` sorted."""
    twice = F.array_distinct(F.filter(ordered, lambda x, i: x == F.get(ordered, i + 1)))

    def among(few: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.array_contains(few, F.get(windows, i)))

    def neighbours(pairs: Column) -> Column:
        same = F.filter(pairs, lambda x, k: x["h"].eqNullSafe(F.get(pairs, k - 1)["h"]) | x["h"].eqNullSafe(F.get(pairs, k + 1)["h"]))
        return F.transform(same, lambda x: x["i"])

    def starts(few: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        many = F.flatten(F.transform(F.array(pairs), neighbours))  # binds the sorted pairs once
        return F.when(F.size(few) == 0, F.array().cast("array<int>")).when(F.size(few) <= 64, among(few)).otherwise(many)

    covered = F.transform(F.array(twice), lambda few: F.size(F.array_distinct(F.flatten(F.transform(starts(few), lambda i: F.array(i, i + 1, i + 2))))))
    return F.get(covered, F.lit(0)).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, chars and common (histograms as counts): one row a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", "lang", text.alias("text"), words(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    codes = F.array(*[F.lit(w) for w in LISTED])

    def bare(w: Column) -> Column:
        return F.rtrim(F.lower(w), F.lit(".,;:!?"))

    marks = F.array_join(F.transform(F.filter(F.transform("w", bare), lambda w: w.isin(LISTED)), lambda w: F.chr(F.array_position(codes, w) + 47)), "")
    windows = F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    )
    counted = split.select(
        "doc_id", "lang", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"), marks.alias("marks"),
        F.length("text").alias("n_chars"), F.length(F.regexp_replace("text", r"\p{Lu}+", "")).alias("without_upper"), F.regexp_replace("text", r"\p{L}+", "").alias("rest"),
    )
    counted = counted.select("*", F.sort_array("windows").alias("ordered"), F.regexp_replace("rest", SYMBOLS, "").alias("rest2"))
    counted = counted.select(
        "*", (F.length("rest") - F.length("rest2")).cast("long").alias("n_symbols"), _repeat_words(F.col("windows"), F.col("ordered")).alias("n_repeat_words"),
        F.regexp_replace("rest2", r"\p{P}+", "").alias("rest3"),
    )
    counted = counted.select("*", F.length(F.regexp_replace("rest3", r"\p{Nd}+", "")).alias("without_digits"), F.length(F.regexp_replace("rest3", r"[\x20\x09-\x0D]+", "")).alias("without_space"))
    upper, three = F.col("n_chars") - F.col("without_upper"), F.length("rest3")
    digits, space = three - F.col("without_digits"), three - F.col("without_space")
    classes = [upper, F.col("n_chars") - F.length("rest") - upper, digits, space, F.length("rest2") - three, F.col("n_symbols"), three - digits - space]
    listed = [F.length("marks") - F.length(F.replace("marks", F.lit(chr(48 + k)), F.lit(""))) for k in range(len(LISTED))]
    return counted.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        F.array(*[x.cast("double") for x in classes]).alias("chars"), F.array(*[x.cast("double") for x in listed], (F.col("n_words") - F.length("marks")).cast("double")).alias("common"),
    )


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / F.greatest(total.cast("double"), F.lit(1.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, base 2, of two histograms of one length that sum to 1."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    parts = F.zip_with(p, q, lambda a, b: (term(a, b) + term(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0)))


def references(feats: DataFrame) -> list[tuple[list[float], list[float]]]:
    """Mean histograms (chars, common) of each listed language: at most len(COMMON_WORDS) rows reach the driver."""
    shares = feats.where(~F.col("base_failed") & F.col("lang").isin(list(COMMON_WORDS))).select("lang", _shares(F.col("chars"), F.col("n_chars")).alias("c"), _shares(F.col("common"), F.col("n_words")).alias("w"))
    means = [F.avg(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(len(CHAR_CLASSES))] + [F.avg(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(len(LISTED) + 1)]
    n = len(CHAR_CLASSES)
    return [([*row[1 : 1 + n]], [*row[1 + n :]]) for row in sorted(shares.groupBy("lang").agg(*means).collect())]


def judge(docs: DataFrame) -> DataFrame:
    """features() with class_distance, common_distance (null where not compared) and kept.

    One pass over the texts: the histograms, some hundred numbers a document, are checkpointed, summed into
    the references, and read again for the verdict.
    """
    feats = cut(features(docs.select("doc_id", "lang", "text")))
    found = references(feats)

    def distance(side: int, column: str, least: int) -> Column:
        each = [js_distance(F.col(column), F.array(*map(F.lit, ref[side]))) for ref in found]
        if not each:
            return F.lit(None).cast("double")
        return F.when(F.col("n_words") >= least, F.least(*each) if len(each) > 1 else each[0])

    def within(column: str, limit: tuple[float, float]) -> Column:
        return F.coalesce(F.col(column) <= F.sqrt(limit[0] ** 2 + limit[1] / F.col("n_words")), F.lit(True))

    shares = feats.select("*", _shares(F.col("chars"), F.col("n_chars")).alias("_chars"), _shares(F.col("common"), F.col("n_words")).alias("_common"))
    compared = shares.select("*", distance(0, "_chars", MIN_WORDS_FOR_CLASSES).alias("class_distance"), distance(1, "_common", MIN_WORDS_FOR_COMMON).alias("common_distance"))
    verdict = ~F.col("base_failed") & within("class_distance", CLASS_LIMIT) & within("common_distance", COMMON_LIMIT)
    return compared.drop("_chars", "_common").withColumn("kept", verdict)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "common_distance")
