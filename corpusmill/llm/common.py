"""What several training-data operators share: reading tables, cutting lineage, words, salted joins."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder; a local session without one (tests) gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def words(text: Column) -> Column:
    """The words of a text, in order; null or blank text has none."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.split(text, SPACE), lambda w: w != ""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def salted_join(large: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "left", salts: int = 32) -> DataFrame:
    """Equi-join in which each key of `large` is dealt over `salts` tasks by `spread`; `small` has a row a key.

    Null keys meet each other. `small` is copied `salts` times, so it should be an aggregate of `large`.
    """
    many = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    left = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumnRenamed(key, "_key").withColumn("_salt_right", many)
    on = left[key].eqNullSafe(right["_key"]) & (left["_salt"] == right["_salt_right"])
    return left.join(right, on, how).drop("_salt", "_salt_right", "_key")
