"""Words of Chinese and Japanese text: the most probable path over a table of words that is learned from the corpus.

Learning counts all character n-grams of CJK and kana runs and keeps those that hold together: wherever a gram is cut in
two, it occurs COHESION times as often as its halves would meet by chance. A run is then split where the product of
its words' shares is largest; characters out of the table are words of their own. Without a table,
`functions.text.tokens` splits by character.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.vectors import AT_ONCE

LONGEST = 4
LEAST, COHESION = 5, 20.0
#: Words that a table may have, by falling counts: they go to the tasks with the code.
MOST_WORDS = 200_000


def gram_counts(texts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """texts (text) -> gram, times: all n-grams of CJK and kana runs up to `longest` characters, counted in tasks before the shuffle."""
    runs = texts.where("text IS NOT NULL").select(F.explode(F.regexp_extract_all("text", F.lit(f"({T.CJK_OR_KANA}+)"))).alias("run"))
    grams = [F.regexp_extract_all("run", F.lit(f"(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, longest + 1)]  # a lookahead at each place: time linear in the run
    return runs.select(F.explode(F.concat(*grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("times"))


def learn_words(texts: DataFrame, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION) -> DataFrame:
    """texts (text) -> word, times: single characters, and grams that occur `least` times and hold together."""
    counts = gram_counts(texts, longest)
    letters = counts.where(F.length("gram") == 1)
    total = letters.agg(F.sum("times")).first()[0] or 0
    cuts = F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda i: F.struct(F.substring("gram", F.lit(1), i).alias("left"), F.substring("gram", i + 1, F.length("gram")).alias("right")))
    often = counts.where((F.length("gram") > 1) & (F.col("times") >= least)).select("gram", "times", F.explode(cuts).alias("cut"))
    left, right = (counts.select(F.col("gram").alias(side), F.col("times").alias(f"{side}_times")) for side in ("left", "right"))
    joined = often.select("gram", "times", "cut.left", "cut.right").join(left, "left").join(right, "right")
    loosest = F.min(F.col("times") * F.lit(float(total)) / (F.col("left_times").cast("double") * F.col("right_times")))
    words = joined.groupBy("gram", "times").agg(loosest.alias("held")).where(F.col("held") >= cohesion)
    return letters.union(words.select("gram", "times")).withColumnRenamed("gram", "word")


def word_weights(words: DataFrame, most: int = MOST_WORDS) -> dict[str, float]:
    """words (word, times) -> the logarithm of each one's share; the `most` frequent, longer ones first among equals."""
    rows = words.orderBy(F.desc("times"), F.desc(F.length("word")), "word").limit(most).collect()
    total = sum(r.times for r in rows)
    return {r.word: math.log(r.times / total) for r in rows}


def best_path(run: str, weights: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The words of the path of the largest sum; of equal ones that with the longest last word, and so on backwards."""
    reached, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for start in range(max(0, end - longest), end):
            weight = weights.get(run[start:end], unknown if end - start == 1 else None)
            if weight is not None and reached[start] + weight > reached[end] + 1e-12:
                reached[end], back[end] = reached[start] + weight, start
    out, at = [], len(run)
    while at:
        out.append(run[back[at] : at])
        at = back[at]
    return out[::-1]


def segmented(text: Column, weights: dict[str, float]) -> Column:
    """Words of CJK and kana runs by the most probable path, and runs of a-z, 0-9 and apostrophe, in order; null has none."""
    longest = max(map(len, weights), default=1)
    unknown = min(weights.values(), default=0.0) - 2.0

    @F.pandas_udf("array<string>")
    def split(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        part = re.compile(f"{T.CJK_OR_KANA}+|[a-z0-9']+")
        for texts in it:
            for a in range(0, len(texts), AT_ONCE):  # words are many times a text's size, and go out as they come
                yield pd.Series([[w for p in part.findall(t) for w in ([p] if p[0] < "\u0080" else best_path(p, weights, longest, unknown))] for t in texts.iloc[a : a + AT_ONCE]], dtype=object)

    return split(F.lower(T.strip(F.coalesce(text, F.lit("")))))
