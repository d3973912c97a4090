"""Incremental forms: ingest of new files' chunks, and dialogs as messages arrive."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmill.operators import layout as L
from corpusmill.operators import titles as TI
from corpusmill.operators.chunks import chunk_text, chunks, text_hash
from corpusmill.operators.reuse import ingest_with_index


def stream_ingest(documents: DataFrame, store: str, checkpoint: str) -> None:
    """Streamed documents (doc_id, text): each batch is chunked, what the store or an earlier document of the batch has is dropped, by the hashes kept beside the store, the rest appended. Stops when all is read."""

    def add(batch: DataFrame, _: int) -> None:
        ingest_with_index(batch_ingest(batch), store, f"{store}_hashes")

    documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def build_chunks(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, stem, filename, language, page_number, block_no, text, x0, y0, x1, y1) of whole documents -> chunk records: page texts, titles, sections, chunks."""
    pages = L.page_text(blocks)
    sections = TI.page_sections(pages.select("doc_id", "page_number"), TI.section_ranges(TI.titles(TI.title_candidates(blocks))))
    return chunks(pages, sections, blocks, blocks.select("doc_id", "stem", "filename", "language").distinct())


def stream_build(blocks: DataFrame, store: str, index: str, checkpoint: str) -> None:
    """Streamed blocks, whole documents a batch: each batch goes through layout, titles and chunks and is added to the store without hashes it has, by the index beside it."""

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.persist(StorageLevel.DISK_ONLY)
        ingest_with_index(build_chunks(rows), store, index)
        rows.unpersist()

    blocks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_counts(messages: DataFrame, sink: str, checkpoint: str) -> None:
    """Streamed messages: message_count and last_turn of each dialog, the whole table after each batch."""
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max("turn").alias("last_turn"))

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class LastMessages(StatefulProcessor):
    """List state a dialog: its last messages (turn, role, text), by turn, later ones of a turn last."""

    def __init__(self, last: int, most: int):
        self.last, self.most = last, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "turn long, role string, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.kept.get()]
        for f in rows:
            kept += zip(f["turn"].tolist(), f["role"].tolist(), f["text"].tolist())
            kept = sorted(kept, key=lambda r: r[0])[-self.last :]  # never more than a batch and the last ones
        self.kept.put(kept)
        yield pd.DataFrame({"conv_id": [key[0]], "context": ["\n".join(f"- {r}: {t[: self.most]}" for _, r, t in kept)]})

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_messages(messages: DataFrame, last: int = 10, most: int = 200) -> DataFrame:
    """Streamed messages (conv_id, turn, role, text) -> after each batch, the changed dialogs' last messages as lines. The session's state store must be RocksDB."""
    return messages.groupBy("conv_id").transformWithStateInPandas(LastMessages(last, most), outputStructType="conv_id long, context string", outputMode="Update", timeMode="None")


def stream_contexts(messages: DataFrame, sink: str, checkpoint: str, last: int = 10) -> None:
    """Streamed messages: each batch's changed contexts are added to the sink under its number; current_contexts has the latest. The state is kept in RocksDB."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")  # a repeated attempt replaces its own rows

    conf = messages.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, ROCKSDB)
    try:
        started = last_messages(messages, last).writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(STATE_STORE, before) if before else conf.unset(STATE_STORE)
    started.awaitTermination()


def current_contexts(spark: SparkSession, sink: str) -> DataFrame:
    rows = spark.read.schema("conv_id long, context string, batch long").parquet(sink)
    return rows.groupBy("conv_id").agg(F.max_by("context", "batch").alias("context"))


def batch_ingest(documents: DataFrame) -> DataFrame:
    return chunk_text(documents.select("doc_id", "text")).withColumn("text_hash", text_hash(F.col("text"))).select("doc_id", "chunk_index", "text", "text_hash")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder; local sessions (tests) without one get a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base}/{uuid.uuid4()}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="stream-")
