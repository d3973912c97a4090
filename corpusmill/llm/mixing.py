"""Mixing of sources to target weights (operator 8).

Every document is emitted floor(rate) times, plus once more with the rate's fraction as
probability, decided by a hash of its id. A source's rate is its target over its size.

Defined results: null text has size 0; null source is a source of its own, last in the order; null ids
are decided like the id ''; rows with one id are decided alike; an empty table gives no rows; columns
beyond doc_id, text and source are ignored by `plan_mix` and carried by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, documents, salted_join, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """sizes (source, size) -> (source, source_size, target).

    Water filling: shares grow in proportion to the weights until a source has `most` times its size;
    with sources in order of the level at which they fill up, the level is the largest of the levels
    left for each source when all before it are full.
    """
    n = len(weights)
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fills_at", "place")
    upto, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(n)) + 1))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("fills_at", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level_here", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0))).cast("double") / F.sum("weight").over(rest))
        .withColumn("level", F.max("level_here").over(every))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))
    )


def _copies(seed: str) -> Column:
    """Copies taken of a row that has doc_id, source_size and target."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    drawn = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))
    return F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)


def plan_mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source_size, target, copies, taken: one row a document.

    Sizes are summed by source with partial sums; the sources' row each is joined back with salts, so
    that a source with a third of all documents is dealt over many tasks.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    planned = salted_join(sizes, source_targets(sizes, weights, most), "source", F.col("doc_id"))
    return (
        planned.withColumn("copies", _copies(seed).cast("long"))
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


#: Sources whose rows (a name and three numbers) may be broadcast; more are joined with salts.
FEW_SOURCES = 10_000


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """The documents of the mix with all their columns, a row for each copy taken."""
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = cut(source_targets(sizes, weights, most).select(F.col("source").alias("_source"), "source_size", "target"))
    rows = docs.select(F.struct("*").alias("_row"), "source", "doc_id")
    if targets.count() <= FEW_SOURCES:
        joined = rows.join(F.broadcast(targets), rows["source"].eqNullSafe(targets["_source"]))
    else:
        joined = salted_join(rows, targets.withColumnRenamed("_source", "source"), "source", F.col("doc_id"))
    return (
        joined.withColumn("_copies", _copies(seed).cast("int")).where("_copies > 0")
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM by_source),
filling AS (SELECT *, CAST(cap AS DOUBLE) / weight AS fills_at FROM weighed),
levels AS (
  SELECT *, CAST((SELECT CAST(sum(source_size) AS BIGINT) FROM by_source)
      - coalesce(CAST(sum(cap) OVER (ORDER BY fills_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY fills_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level_here
  FROM filling),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT max(level_here) FROM levels)) AS target FROM levels),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(CAST(concat('0x', substr(md5(concat('mix-1:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS drawn
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM rated
"""
