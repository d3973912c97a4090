"""Approximate vector top-k by an inverted file: cells of a k-means, items stored by cell, queries that read their nearest cells only.

An index is a folder: `centroids` (cell, centroid), learned once, and `items`, partitioned by cell, with all of the
items' columns. The cells are learned on a bounded sample; every item is indexed and may be appended later. Scores within
the probed cells are exact, so that probing all cells gives the exact result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corpusmill.operators.ingest import saved
from corpusmill.operators.search import FEW_QUERIES, Nearest, as_matrix, best, equal_runs, masked_many

#: Items a cell that the sample holds at most; the cells are learned on so many times their number.
SAMPLE = 64
#: Most cells: their centroids go with the code.
MOST_CELLS = 4096


def cells_for(n: int) -> int:
    """About the square root of the number of items, so that probing and listing cost alike."""
    return max(1, min(MOST_CELLS, round(n**0.5)))


def fit_cells(items: DataFrame, cells: int, seed: int = 1, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of k-means by angle, on up to `sample` items a cell (those of the least hashes); fewer if items repeat."""
    known = items.where("size(vector) > 0").select(F.col("vector").cast("array<double>").alias("vector"))
    known = known.where(F.exists("vector", lambda x: x != 0))
    few = known.orderBy(F.xxhash64("vector")).limit(cells * sample).select(array_to_vector("vector").alias("features")).persist()
    try:
        if not few.take(1):
            return np.zeros((0, 0))
        model = KMeans(k=max(cells, 2), seed=seed, distanceMeasure="cosine", maxIter=10).fit(few)
    finally:
        few.unpersist()
    found = np.array(model.clusterCenters())[: max(cells, 1)] if cells > 1 else np.array(model.clusterCenters()).mean(axis=0, keepdims=True)
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def with_cells(rows: DataFrame, centroids: np.ndarray, probes: int = 1, vector: str = "vector") -> DataFrame:
    """The rows that have a vector (not null or empty), with `cells`, the numbers of their nearest centroids."""
    full = rows.where(F.size(vector) > 0)
    schema = StructType([*full.schema.fields, StructField("cells", ArrayType(IntegerType()))])
    place = full.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.asarray(batch.column(place).flatten(), dtype=float).reshape(batch.num_rows, -1) @ centroids.T
            n = min(probes, scores.shape[1])
            near = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < scores.shape[1] else np.tile(np.arange(n), (batch.num_rows, 1))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, n), pa.int32()), pa.array(near.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    return full.mapInArrow(run, schema) if len(centroids) else full.withColumn("cells", F.array(F.lit(0)))


def build_index(items: DataFrame, path: str, cells: int | None = None, seed: int = 1, sample: int = SAMPLE) -> None:
    """Learns the cells and stores all items that have a vector; an index at path goes."""
    spark = items.sparkSession
    centroids = fit_cells(items, cells or cells_for(items.count()), seed, sample)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    _add(items, path, centroids, "overwrite")


def append_index(items: DataFrame, path: str) -> None:
    """Adds items to an index by its cells, which stay as they were learned."""
    _add(items, path, read_centroids(items.sparkSession, path), "append")


def _add(items: DataFrame, path: str, centroids: np.ndarray, mode: str) -> None:
    # rebalanced by cell, so that a cell has few files and a large one is dealt over many tasks
    dealt = with_cells(items, centroids).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")
    dealt.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/items")


def read_centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MOST_CELLS at most
    return np.array([r.centroid for r in rows]) if rows else np.zeros((0, 0))


def search_index(queries: DataFrame, path: str, k: int, probes: int = 32, item: str = "id") -> DataFrame:
    """queries (query_id, q_vector) -> (query_id, item, score, rank) from each query's `probes` nearest cells.

    Up to FEW_QUERIES queries go with the code, and only the partitions of cells that one of them probes are read; more
    meet the items by cell, in parts by the cells' sizes. Null and empty vectors have no hits.
    """
    spark = queries.sparkSession
    items = saved(spark, f"{path}/items", {})
    if items is None:  # an index of nothing
        return spark.createDataFrame([], f"query_id long, {item} string, score double, rank int")
    centroids = read_centroids(spark, path)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q_vector").cast("array<double>").alias("q"))
    asked = with_cells(asked, centroids, probes, "q")
    given = items.select(item, F.col("vector").cast("array<double>").alias("vector"), "cell")
    few = asked.limit(FEW_QUERIES + 1).collect()
    if len(few) <= FEW_QUERIES:
        return best(_of_few(few, given, k, item), k, item)
    none = F.lit(None).cast("double")
    by_cell = given.select(item, "vector", none.alias("page"), F.col("cell").cast("string").alias("scope"))
    probed = asked.select("query_id", F.explode(F.col("cells").cast("array<string>")).alias("scope"))
    return best(masked_many(asked.select("query_id", "q", none.alias("low"), none.alias("high")), by_cell, probed, k, False, item), k, item)


def _of_few(few: list, items: DataFrame, k: int, item: str) -> DataFrame:
    ids, matrix, by_cell = np.array([r.query_id for r in few], np.int64), np.array([r.q for r in few]), {}
    for i, r in enumerate(few):
        for c in r.cells:
            by_cell.setdefault(c, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(ids, matrix, k, item)
        for batch in batches:
            cells, vectors = batch.column(2).to_numpy(), as_matrix(batch.column(1))
            for a, b in equal_runs(cells):
                near.add(batch.column(0).slice(a, b - a), vectors[a:b], np.array(by_cell[int(cells[a])]))
        yield from near.hits()

    return items.where(F.col("cell").isin(list(by_cell))).mapInArrow(run, f"query_id long, {item} {dict(items.dtypes)[item]}, score double")
