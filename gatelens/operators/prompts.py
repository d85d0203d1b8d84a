"""Message-level reshaping: conversations (one row per message) → prompt texts.

All operators group by conversation id only; a conversation's messages are
one bounded group, gathered map-side-partially and sorted by turn inside the
group (``array_sort`` of ``struct(turn, ...)``), so no global sort is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def text_parts(conversations: DataFrame) -> Column:
    """Texts of a message as array<string>: the plain string, or the text blocks of multi-part content
    (``text`` as array<struct<type, text, ...>>; image and tool blocks are left out). A null text has none."""
    if isinstance(conversations.schema["text"].dataType, ArrayType):
        blocks = F.filter("text", lambda b: (b["type"] == "text") & b["text"].isNotNull())
        return F.coalesce(F.transform(blocks, lambda b: b["text"]), F.array().cast("array<string>"))
    return F.when(F.col("text").isNotNull(), F.array("text")).otherwise(F.array().cast("array<string>"))


def flatten_prompts(conversations: DataFrame) -> DataFrame:
    """One string per conversation: ``role: text`` per message - per text block of multi-part content - in turn order,
    newline-joined. Messages without text are skipped."""
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    lines = F.transform(text_parts(conversations), lambda t: F.concat(role, F.lit(": "), t))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("k"), lines.alias("v"))))
    return conversations.groupBy("conv_id").agg(
        F.array_join(F.flatten(F.transform(ordered, lambda x: x["v"])), "\n").alias("prompt"))


def last_user_text(conversations: DataFrame) -> DataFrame:
    """Text of the last user message per conversation, its text blocks joined by a space; '' when there is none."""
    is_user = F.col("role") == "user"
    text = F.array_join(text_parts(conversations), " ")
    return conversations.groupBy("conv_id").agg(
        F.coalesce(F.max_by(F.when(is_user, text), F.when(is_user, F.col("turn"))), F.lit("")).alias("user_text"))


def turn_pairs(conversations: DataFrame, n_apps: int = 3) -> DataFrame:
    """Each assistant turn with the latest earlier user text (running frame, no self-join)."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    prev_user = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return (conversations
            .withColumn("request", F.coalesce(prev_user, F.lit("")))
            .filter(F.col("role") == "assistant")
            .select("conv_id", "turn",
                    F.concat(F.lit("app_"), (F.col("conv_id") % n_apps).cast("string")).alias("app_id"),
                    "request", F.coalesce(F.col("text"), F.lit("")).alias("response")))


def split_system(conversations: DataFrame) -> DataFrame:
    """System messages lifted into one newline-joined field (NULL if none); the rest kept in order."""
    is_sys = F.coalesce(F.col("role") == "system", F.lit(False))
    line = F.concat(F.coalesce(F.col("role"), F.lit("unknown")), F.lit(": "), F.coalesce(F.col("text"), F.lit("")))
    sys_parts = F.array_sort(F.collect_list(F.when(is_sys, F.struct(F.col("turn").alias("k"), F.col("text").alias("v")))))
    rest_parts = F.array_sort(F.collect_list(F.when(~is_sys, F.struct(F.col("turn").alias("k"), line.alias("v")))))
    return (conversations.groupBy("conv_id")
            .agg(sys_parts.alias("s"), rest_parts.alias("r"))
            .select("conv_id",
                    F.when(F.size("s") > 0, F.array_join(F.transform("s", lambda x: x["v"]), "\n")).alias("system"),
                    F.array_join(F.transform("r", lambda x: x["v"]), "\n").alias("messages"),
                    F.size("r").cast("long").alias("n_messages")))


def filter_clean_prompts(df: DataFrame, text: str = "text", lo: int = 20, hi: int = 512) -> DataFrame:
    """Keep texts with lo <= length <= hi characters."""
    n = F.length(F.col(text))
    return df.filter((n >= lo) & (n <= hi))


def clean_prompt_counts(df: DataFrame, by: str = "source", text: str = "text", lo: int = 20, hi: int = 512) -> DataFrame:
    n = F.length(F.col(text))
    keep = (n >= lo) & (n <= hi)
    return df.groupBy(by).agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))
