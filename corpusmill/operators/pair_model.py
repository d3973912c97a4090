"""A pair scorer that is trained on the corpus itself, to rerank hits.

Training pairs are those of a known-item search: some words of a passage, with gaps, are the query, the chunk it was taken from is the right
answer, and other chunks that are near to the query by vector are wrong ones. A logistic regression learns what
tells them apart from a few features of a pair, which are DataFrame expressions; its score is one more expression, so that
reranking runs no Python.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vectors as V
from corpusmill.operators import ingest as I
from corpusmill.operators.search import vector_topk, with_texts, words_lost

#: Chunks that give a training pair, at most: those of the least hashes of their ids.
SAMPLE = 2_000
#: Wrong answers a query, from its nearest chunks.
NEAR = 10
#: Words of a passage, of which a query keeps about two thirds; chunks with as many or more give one.
PASSAGE = 12
FEATURES = ("shared", "common", "pairs", "size")


def features(query: Column, text: Column) -> Column:
    """FEATURES of a pair cut to a model's length, as an array: the lexical score, the share of the query's words and of its word pairs that the text has, and the text's size.

    The vector score is none: wrong answers are chosen by it, so that a low one would seem to be right.
    """

    def pairs(ws: Column) -> Column:
        return F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(ws, i + 1)))

    def share(a: Column, b: Column) -> Column:
        return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.lit(1))

    def cut(s: Column) -> Column:
        from_q, from_t = words_lost(F.size(s["q"]), F.size(s["t"]))
        return F.struct(F.slice(s["q"], F.lit(1), F.size(s["q"]) - from_q).alias("q"), F.slice(s["t"], F.lit(1), F.size(s["t"]) - from_t).alias("t"))

    def values(s: Column) -> Column:
        common = share(s["q"], s["t"])
        return F.array(common / (1 + F.size(s["t"]) / 100), common, share(pairs(s["q"]), pairs(s["t"])), F.log1p(F.size(s["t"])))

    # lambdas bind the words, so that each text is split once
    words = F.struct(T.words(F.lower(query)).alias("q"), T.words(F.lower(text)).alias("t"))
    return F.get(F.transform(F.transform(F.array(words), cut), values), F.lit(0))


def training_pairs(chunks: DataFrame, sample: int = SAMPLE, near: int = NEAR) -> DataFrame:
    """chunks (id, text, vector) -> query_id, query, id, text, score, label: a right answer for each sampled passage, and `near` wrong ones."""
    ws = T.words(F.col("text"))
    some = chunks.select("id", "text", "vector", ws.alias("ws")).where(F.size("ws") >= PASSAGE).orderBy(F.xxhash64("id"), "id").limit(sample)
    at = (F.pmod(F.xxhash64("id", F.lit(1)), F.size("ws") - PASSAGE + 1) + 1).cast("int")
    kept = F.filter(F.slice("ws", at, F.lit(PASSAGE)), lambda w, i: F.pmod(F.xxhash64(F.col("id"), i), F.lit(3)) > 0)
    taken = some.select("id", F.xxhash64("id").alias("query_id"), F.array_join(kept, " ").alias("query"), "text", "vector").where("query <> ''")
    asked = I.embed_text(taken.select("id", "query_id", "query"), "query").withColumnRenamed("vector", "q_vector")
    right = taken.join(asked.select("query_id", "q_vector"), "query_id")
    right = right.select("query_id", "query", "id", "text", F.round(V.dot(F.col("vector"), F.col("q_vector")), 6).alias("score"), F.lit(1).alias("label"))
    hits = with_texts(vector_topk(asked, chunks, near + 1), asked, chunks)
    own = taken.select("query_id", F.col("id").alias("_own"))
    wrong = hits.join(own, "query_id").where("id <> _own AND rank <= " + str(near + 1)).select("query_id", "query", "id", "text", "score", F.lit(0).alias("label"))
    return right.unionByName(wrong)


def fit(pairs: DataFrame) -> list[float]:
    """Weights of FEATURES and the intercept, last."""
    rows = pairs.select(F.col("label").cast("double"), array_to_vector(features(F.col("query"), F.col("text"))).alias("features")).persist()
    try:
        model = LogisticRegression(regParam=1e-3, maxIter=25).fit(rows)
    finally:
        rows.unpersist()
    return [*map(float, model.coefficients), float(model.intercept)]


def pair_score(weights: list[float], query: str = "query", text: str = "text") -> Column:
    """The logit of a pair, for `search.rerank` and `search.blend`."""
    weighted = F.zip_with(features(F.col(query), F.col(text)), F.array(*map(F.lit, weights[:-1])), lambda f, w: f * w)
    return F.aggregate(weighted, F.lit(weights[-1]), lambda total, x: total + x)
