"""Dialog log: messages (conv_id, turn, role, text) to lists, histories and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_title(conv_id: Column) -> Column:
    return F.concat(F.lit("对话 "), F.substring(conv_id.cast("string"), 1, 8))


def dialog_list(messages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """title (by default from the id), message_count and last_turn of each dialog."""
    default = default_title(F.col("conv_id"))
    base = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max("turn").alias("last_turn"))
    if titles is None:
        return base.select("conv_id", default.alias("title"), "message_count", "last_turn")
    return base.join(titles.select("conv_id", "title"), "conv_id", "left").select("conv_id", F.coalesce("title", default).alias("title"), "message_count", "last_turn")


def dialog_history(messages: DataFrame) -> DataFrame:
    role = F.when(F.col("role").isin("human", "user"), "human").when(F.col("role").isin("ai", "assistant"), "ai").otherwise("assistant")
    return messages.select("conv_id", "turn", role.alias("role"), "text")


def append_exchange(messages: DataFrame, exchanges: DataFrame) -> DataFrame:
    """exchanges (conv_id, question, answer) after each dialog's last turn, as two messages."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    pair = F.array(F.struct(F.lit(1).alias("k"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit(2).alias("k"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    new = exchanges.join(last, "conv_id", "left").select("conv_id", F.coalesce("last", F.lit(-1)).alias("last"), F.explode(pair).alias("m")).select("conv_id", (F.col("last") + F.col("m.k")).alias("turn"), "m.role", "m.text")
    return messages.select("conv_id", "turn", "role", "text").union(new)


def delete_dialogs(messages: DataFrame, tombstones: DataFrame) -> DataFrame:
    return messages.join(tombstones.select("conv_id").distinct(), "conv_id", "left_anti")


def latest_titles(changes: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes (conv_id, changed_at, title) -> (the latest title of each known dialog, changes of unknown ones)."""
    known = messages.select("conv_id").distinct()
    return changes.join(known, "conv_id", "left_semi").groupBy("conv_id").agg(F.max_by("title", "changed_at").alias("title")), changes.join(known, "conv_id", "left_anti")


def dialog_context(messages: DataFrame, last: int = 10, most: int = 200) -> DataFrame:
    """The last messages of each dialog as lines `- role: text`."""
    recent = messages.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= last)
    line = F.concat(F.lit("- "), "role", F.lit(": "), F.substring("text", 1, most))
    return recent.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


def last_assistant(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def conversation_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id", "role").agg(F.count("*").alias("messages"))
