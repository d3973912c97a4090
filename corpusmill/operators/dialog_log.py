"""An append-only log of dialogs: messages, titles, openings and deletions as events, with the state as a view.

Events (at, seq, kind, conv_id, turn, role, text) are ordered by (batch, seq); kind is open, message, title (its text) or
delete. A deletion ends all earlier events of its dialog. Batches are only ever added. Compaction writes what is alive
up to a batch as a snapshot and then enters it in the list of snapshots; a reader takes the last snapshot that is entered
and the later batches, so that it sees one state whether a compaction is running, has failed or is done.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.dialogs import default_title
from corpusmill.operators.ingest import exists, saved

EVENT = "seq bigint, at timestamp, kind string, conv_id string, turn bigint, role string, text string"
KINDS = ("open", "message", "title", "delete")
COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


def message_events(messages: DataFrame, at, first_seq: int = 0) -> DataFrame:
    """messages (conv_id, turn, role, text) as events; `at` is a column or a time."""
    time = F.lit(at) if isinstance(at, datetime) else at
    return messages.select((F.col("turn") + first_seq).cast("long").alias("seq"), time.cast("timestamp").alias("at"), F.lit("message").alias("kind"), F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


def append_events(events: DataFrame, path: str, batch: int) -> None:
    """Adds a batch; one that was added before is replaced by the same events, so that a repeated attempt changes nothing. Batches ascend."""
    events.select(*COLUMNS).write.mode("overwrite").parquet(f"{path}/log/batch={batch}")


def log_events(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The last snapshot's events and those of later batches, with their batch; none where there is no log. Only the later batches' files are read."""
    if not exists(spark, f"{path}/log"):
        return spark.createDataFrame([], f"{EVENT}, batch bigint")
    entered = saved(spark, f"{path}/snapshots", {"upto": "bigint"})
    last = None if entered is None else (entered if upto is None else entered.where(F.col("upto") <= upto)).agg(F.max("upto")).first()[0]
    log = spark.read.schema(f"{EVENT}, batch bigint").parquet(f"{path}/log")
    if upto is not None:
        log = log.where(F.col("batch") <= upto)
    if last is None:
        return log
    kept = spark.read.schema(f"{EVENT}, batch bigint").parquet(f"{path}/snapshot-{last}")
    return log.where(F.col("batch") > last).unionByName(kept)


def alive(events: DataFrame) -> DataFrame:
    """Events after their dialog's last deletion, deletions left out: one shuffle by dialog, no sort."""
    order = F.struct("batch", "seq")
    ended = F.max(F.when(F.col("kind") == "delete", order)).over(Window.partitionBy("conv_id"))
    return events.withColumn("_ended", ended).where((F.col("kind") != "delete") & (F.col("_ended").isNull() | (order > F.col("_ended")))).drop("_ended")


def compact(spark: SparkSession, path: str, upto: int) -> int:
    """A snapshot of what is alive up to a batch, entered once it is whole; returns its number of events. Of titles, the latest stay.

    `open` events stand for the times of what is left out, so that created and updated do not change.
    """
    now = alive(log_events(spark, path, upto))
    dialog = Window.partitionBy("conv_id")
    latest = F.max(F.when(F.col("kind") == "title", F.struct("batch", "seq"))).over(dialog)
    marked = now.select("*", latest.alias("_title"), F.min("at").over(dialog).alias("_first"), F.max("at").over(dialog).alias("_last"))
    kept = marked.where((F.col("kind") == "message") | ((F.col("kind") == "title") & (F.struct("batch", "seq") == F.col("_title")))).select(*COLUMNS, "batch")
    ends = marked.groupBy("conv_id").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min(F.struct("batch", "seq")).alias("o"))
    opened = ends.select(F.col("o.seq").alias("seq"), F.explode(F.array_distinct(F.array("first", "last"))).alias("at"), F.lit("open").alias("kind"), "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.col("o.batch").alias("batch"))
    kept.unionByName(opened).write.mode("overwrite").parquet(f"{path}/snapshot-{upto}")
    n = spark.read.parquet(f"{path}/snapshot-{upto}").count()
    spark.range(1).select(F.lit(upto).cast("long").alias("upto")).write.mode("append").parquet(f"{path}/snapshots")
    return n


def dialog_view(events: DataFrame) -> DataFrame:
    """conv_id, title (the latest, by default from the id), created, updated, message_count, last_turn of the living dialogs."""
    is_message = F.col("kind") == "message"
    return (
        alive(events).groupBy("conv_id").agg(
            F.max_by(F.when(F.col("kind") == "title", F.col("text")), F.when(F.col("kind") == "title", F.struct("batch", "seq"))).alias("given"),
            F.min("at").alias("created"), F.max("at").alias("updated"), F.count_if(is_message).alias("message_count"), F.max(F.when(is_message, F.col("turn"))).alias("last_turn"),
        ).select("conv_id", F.coalesce("given", default_title(F.col("conv_id"))).alias("title"), "created", "updated", "message_count", "last_turn")
    )


def message_view(events: DataFrame) -> DataFrame:
    return alive(events).where("kind = 'message'").select("conv_id", "turn", "role", "text", "at")


def histories(asked: DataFrame, events: DataFrame) -> DataFrame:
    """asked (conv_id) -> known, and messages (turn, role, text) in order: null for an unknown dialog, empty for one without messages."""
    living = alive(events)
    message = F.when(F.col("kind") == "message", F.struct("turn", "role", "text"))
    found = living.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    return asked.select("conv_id").distinct().join(found, "conv_id", "left").select("conv_id", F.col("messages").isNotNull().alias("known"), "messages")


def deletion_events(spark: SparkSession, events: DataFrame, ids: DataFrame, at: datetime, seq: int, fresh: str) -> DataFrame:
    """Deletions of the known ones among ids; where that would leave no dialog, `fresh` is opened first."""
    living = alive(events).select("conv_id").distinct()
    gone = living.join(ids.select(F.col("conv_id").cast("string").alias("conv_id")).distinct(), "conv_id", "left_semi")
    left = living.join(gone, "conv_id", "left_anti").limit(1).count()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
    deleted = gone.select(F.lit(seq + 1).cast("long").alias("seq"), F.lit(at).cast("timestamp").alias("at"), F.lit("delete").alias("kind"), "conv_id", *none)
    if left or not gone.limit(1).count():
        return deleted
    return deleted.unionByName(spark.range(1).select(F.lit(seq).cast("long").alias("seq"), F.lit(at).cast("timestamp").alias("at"), F.lit("open").alias("kind"), F.lit(fresh).alias("conv_id"), *none))


def exchange_events(exchanges: DataFrame, events: DataFrame, at: datetime, seq: int) -> DataFrame:
    """exchanges (conv_id, question, answer) after each living dialog's last turn, as two messages each; those of unknown dialogs open them."""
    last = alive(events).where("kind = 'message'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    pair = F.array(F.struct(F.lit(1).alias("k"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit(2).alias("k"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    given = exchanges.select(F.col("conv_id").cast("string").alias("conv_id"), "question", "answer")
    return given.join(last, "conv_id", "left").select("conv_id", F.coalesce("last", F.lit(-1)).alias("last"), F.explode(pair).alias("m")).select(
        (F.lit(seq) + F.col("m.k")).cast("long").alias("seq"), F.lit(at).cast("timestamp").alias("at"), F.lit("message").alias("kind"), "conv_id", (F.col("last") + F.col("m.k")).cast("long").alias("turn"), "m.role", "m.text"
    )
