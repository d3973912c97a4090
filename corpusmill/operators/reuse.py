"""What an incremental build keeps beside the store: hashes by bucket, vectors by text hash, and counts of its runs."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.ingest import exists, ingest_dedup, saved

#: Partitions of a sidecar: the buckets that a batch's hashes fall in are read, the others are not.
BUCKETS = 256


def bucket(hashed: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(hashed.cast("binary")), F.lit(buckets)).cast("int")


def write_bucketed(rows: DataFrame, path: str, key: str) -> None:
    """Appends rows to a table partitioned by the bucket of their key, sorted, with Parquet's Bloom filters on the key."""
    dealt = rows.withColumn("bucket", bucket(F.col(key))).hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
    dealt.write.mode("append").option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("bucket").parquet(path)


def matching_buckets(spark: SparkSession, path: str, batch: DataFrame, key: str, columns: dict[str, str]) -> DataFrame | None:
    """The rows of the table whose bucket some row of the batch has; None if there is no table. At most BUCKETS numbers reach the driver."""
    found = saved(spark, path, columns)
    if found is None:
        return None
    wanted = [r[0] for r in batch.where(F.col(key).isNotNull()).select(bucket(F.col(key))).distinct().collect()]
    return found.where(F.col("bucket").isin(wanted)).select(*columns)


def ingest_with_index(new: DataFrame, store: str, index: str) -> int:
    """Appends a batch of chunks (doc_id, text_hash, ...) to the store without hashes it has; returns how many rows are new.

    The hashes stand in a bucketed sidecar, so that a batch reads its own buckets and no file of the store. The sidecar is
    written after the store: should only that fail, `rebuild_index` makes it from the store before the next batch, as it does
    by itself for a store that has none.
    """
    spark = new.sparkSession
    new = new.persist(StorageLevel.DISK_ONLY)
    try:
        if exists(spark, store) and not exists(spark, index):
            rebuild_index(spark, store, index)
        old = matching_buckets(spark, index, new.where("text_hash <> ''"), "text_hash", {"text_hash": "string"})
        kept = ingest_dedup(new, new.limit(0) if old is None else old).persist(StorageLevel.DISK_ONLY)
        try:
            n = kept.count()
            kept.write.mode("append").parquet(store)
            write_bucketed(kept.where("text_hash <> ''").select("text_hash").distinct(), index, "text_hash")
        finally:
            kept.unpersist()
        return n
    finally:
        new.unpersist()


def rebuild_index(spark: SparkSession, store: str, index: str) -> None:
    """The sidecar anew from the store's hashes, for a store that has none, or whose writer stopped between the two."""
    hashes = spark.read.parquet(store).where("text_hash <> ''").select("text_hash").distinct()
    hashes.withColumn("bucket", bucket(F.col("text_hash"))).hint("rebalance", "bucket").write.mode("overwrite").option("parquet.bloom.filter.enabled#text_hash", "true").partitionBy("bucket").parquet(index)


def watched(rows: DataFrame, *counts: Column) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """rows under observation, and what gives the counts once a job has read them.

    Where all that is above them turns out empty, the engine drops them from its plan with their observation; only then are
    they counted by a job of their own.
    """
    seen = Observation()

    def result() -> dict[str, int]:
        try:
            return seen.get
        except Py4JJavaError:
            return rows.agg(*counts).first().asDict()

    return rows.observe(seen, *counts), result


def encode_cached(rows: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], text: str = "text") -> tuple[DataFrame, dict[str, int]]:
    """rows with `vector`, from a table (text_hash, vector) kept at path; and counts: texts, hits (distinct texts found there), misses.

    `encode` gets the distinct texts that are not there (text_hash, text) and adds vector; they are added to the table before
    the result is read from it. Null texts have no vector. A full md5 is the key. The counts are observed as the misses are written.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", F.md5(F.col(text)))
    asked = keyed.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.first(text).alias("text")).withColumnRenamed("_key", "text_hash")
    stored = matching_buckets(spark, path, asked, "text_hash", {"text_hash": "string", "vector": "array<double>"})
    if stored is None:
        marked = asked.withColumn("_hit", F.lit(False))
    else:
        marked = asked.join(stored.select("text_hash", F.lit(True).alias("_hit")), "text_hash", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    marked, seen = watched(marked, F.count("*").alias("texts"), F.count_if("_hit").alias("hits"))
    missing = encode(marked.where(~F.col("_hit")).select("text_hash", "text")).select("text_hash", F.col("vector").cast("array<double>").alias("vector"))
    write_bucketed(missing, path, "text_hash")
    counts = seen()
    table = matching_buckets(spark, path, asked, "text_hash", {"text_hash": "string", "vector": "array<double>"})
    if table is None:  # nothing was ever written: no text but null
        table = asked.select("text_hash", F.lit(None).cast("array<double>").alias("vector")).limit(0)
    result = keyed.join(table.withColumnRenamed("text_hash", "_key"), "_key", "left").drop("_key")
    return result, {"texts": counts["texts"], "hits": counts["hits"], "misses": counts["texts"] - counts["hits"]}


def counted_run(files: DataFrame, processed: DataFrame, parse: Callable[[DataFrame], DataFrame], store: str, key: str = "file_path") -> dict[str, int]:
    """Parses the files that are not processed yet and appends the rows; returns files, skipped, failed, processed and rows of the run.

    `parse` gets files with their columns and gives them with `rows`, an array of structs: null for one that cannot be
    read. The totals are observed as the rows pass on to the store, without another pass.
    """
    known = processed.select(key).distinct().withColumn("_known", F.lit(True))
    marked, all_files = watched(files.join(known, key, "left"), F.count("*").alias("files"), F.count_if(F.coalesce("_known", F.lit(False))).alias("skipped"))
    parsed = parse(marked.where("_known IS NULL").drop("_known"))
    counted, done = watched(parsed, F.count_if(F.col("rows").isNull()).alias("failed"), F.count("rows").alias("processed"), F.coalesce(F.sum(F.size("rows")), F.lit(0)).alias("rows"))
    counted.select(key, F.explode("rows").alias("r")).select(key, "r.*").write.mode("append").parquet(store)
    return all_files() | done()
