"""Chat threads and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.functions import text as T

HISTORY = 20


def thread_list(messages: DataFrame) -> DataFrame:
    """Turns, time of the last and how many the history leaves out, by node and problem; the null thread is one of its own."""
    out = messages.groupBy("node_id", "problem_no").agg(F.count("*").alias("turns"), F.max("created_at").alias("last_at"))
    return out.withColumn("truncated", F.greatest(F.col("turns") - HISTORY, F.lit(0)))


def last_messages(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """The newest n of each thread, with place (oldest first). Spark cuts the window early at row_number <= n."""
    thread = Window.partitionBy("node_id", "problem_no")
    newest = messages.withColumn("back", F.row_number().over(thread.orderBy(F.desc("created_at"), F.desc("seq")))).filter(F.col("back") <= n)
    return newest.withColumn("place", F.row_number().over(thread.orderBy(F.desc("back")))).drop("back")


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Each conversation with the preview of its last message, null when it has none. An aggregate, not a sort of messages."""
    last = messages.groupBy("conv_id").agg(F.max_by("content", F.struct("created_at", "seq")).alias("content"))
    return conversations.join(last, "conv_id", "left").withColumn("preview", T.preview(F.col("content"))).drop("content")


def auto_titles(conversations: DataFrame, messages: DataFrame, default: str) -> DataFrame:
    """A title that is still the default becomes the first message's beginning."""
    first = messages.groupBy("conv_id").agg(F.min_by("content", F.struct("created_at", "seq")).alias("content"))
    out = conversations.join(first, "conv_id", "left")
    return out.withColumn("title", F.when(F.col("content").isNotNull() & (F.col("title") == default), T.auto_title(F.col("content"), default)).otherwise(F.col("title"))).drop("content")


def chat_context(messages: DataFrame, problems: DataFrame, solutions: DataFrame) -> DataFrame:
    """Each message with its problem's text and saved solution; messages of the whole-exam thread get the exam's summary."""
    summary = problems.groupBy("node_id").agg(F.count("*").alias("exam_problems"))
    out = messages.join(problems.select("node_id", "problem_no", "text"), ["node_id", "problem_no"], "left").join(solutions.select("node_id", "problem_no", "solution"), ["node_id", "problem_no"], "left").join(summary, "node_id", "left")
    about = F.when(F.col("problem_no").isNull(), F.concat_ws(" ", F.lit("problems:"), F.coalesce("exam_problems", F.lit(0)))).otherwise(F.concat_ws("\n", "text", "solution"))
    return out.withColumn("context", about).drop("text", "solution", "exam_problems")
