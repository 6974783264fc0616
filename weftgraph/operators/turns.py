"""Conversation analytics on message rows: turns, character budgets, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators.segments import running_sums


def turns(messages: DataFrame) -> DataFrame:
    """``conversation_id, turn_no, user_text, assistant_text, n_tool_calls, ts``.

    ``messages`` has ``conversation_id, role, content, place`` (an order) and optionally ``reasoning, n_tools, ts``. A turn
    opens at a user row; the last assistant content that is not blank counts, with its reasoning; tool calls add up.
    Rows before the first user row and system rows are skipped; turns without assistant text and tools are dropped.
    """
    have = messages.columns
    m = messages.where(F.col("role") != "system")
    m = running_sums(m, ["conversation_id"], ["place"], {"turn_no": F.when(F.col("role") == "user", 1).otherwise(0)}).where("turn_no > 0")
    other = F.col("role") != "user"
    said = other & F.col("content").rlike(r"[^\s\p{Z}]")
    text = F.concat("content", F.when(F.length("reasoning") > 0, F.concat(F.lit("\n\nReasoning: "), "reasoning")).otherwise("")) if "reasoning" in have else F.col("content")
    tools = F.coalesce(F.col("n_tools"), F.lit(0)) if "n_tools" in have else F.lit(0)
    when = F.col("ts") if "ts" in have else F.col("place")
    g = m.groupBy("conversation_id", "turn_no").agg(
        F.max(F.when(~other, F.col("content"))).alias("user_text"),
        F.max_by(F.when(said, text), F.when(said, F.col("place"))).alias("_text"),
        F.sum(F.when(other, tools).otherwise(0)).cast("long").alias("n_tool_calls"),
        F.max(F.when(other, when)).alias("ts"),
    )
    return g.where("_text is not null or n_tool_calls > 0").withColumn("assistant_text", F.coalesce("_text", F.lit(""))).drop("_text")


def within_budget(messages: DataFrame, size: str, budget: int, key: str = "conversation_id", place: str = "place") -> DataFrame:
    """The newest rows whose running size stays within the budget: a strict prefix from the newest backwards.

    What is newer than a row is its group's total without what comes up to it.
    """
    upto = running_sums(messages, [key], [place], {"_upto": F.col(size)})
    total = messages.groupBy(F.col(key).alias("_k")).agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"))
    got = upto.join(total, F.col(key).eqNullSafe(F.col("_k")))
    running = F.col("_total") - F.col("_upto") + F.coalesce(F.col(size), F.lit(0))
    return got.select(*messages.columns, running.alias("running")).where(F.col("running") <= budget)


def last_n(messages: DataFrame, n: int, key: str = "conversation_id", place: str = "place") -> DataFrame:
    """The newest n rows per conversation, oldest first by ``position``. The limit is applied before the shuffle as well."""
    w = W.partitionBy(key).orderBy(F.col(place).desc())
    got = messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    # at most n rows a conversation are left
    return got.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(place))).drop("_r")


def char_offsets(messages: DataFrame, size: str, key: str = "conversation_id", place: str = "place") -> DataFrame:
    """Rows with ``start_char`` and ``end_char``, cumulative within the conversation."""
    got = running_sums(messages, [key], [place], {"end_char": F.col(size)})
    return got.withColumn("start_char", F.col("end_char") - F.col(size))


def summary_due(messages: DataFrame, summarised: DataFrame, size: str, max_context: int = 100_000, key: str = "conversation_id", place: str = "place") -> DataFrame:
    """``conversation_id, start_char, end_char, n_messages, chars`` of conversations whose unsummarised part reached a tenth of the context.

    ``summarised`` has the last covered offset as ``upto``. Rows are collected until the range reaches the threshold:
    what lies before a row of the open part is its offset without that of the part's first row.
    """
    limit = max_context // 10
    m = char_offsets(messages, size, key, place).join(summarised.select(key, "upto"), key, "left").where(F.col("end_char") > F.coalesce("upto", F.lit(0)))
    first = m.groupBy(F.col(key).alias("_k")).agg(F.min("start_char").alias("_from"))
    part = m.join(first, F.col(key) == F.col("_k")).where(F.col("start_char") - F.col("_from") < limit)
    return part.groupBy(key).agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.count(F.lit(1)).alias("n_messages"), F.sum(size).alias("chars")).where(F.col("chars") >= limit)


def second_level_due(summaries: DataFrame) -> DataFrame:
    """Conversations with at least two first-level summaries that no second-level one covers, and their turn range."""
    open_ = summaries.where("level = 1 and not coalesce(covered, false)")
    return open_.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_turn").alias("start_turn"), F.max("end_turn").alias("end_turn")).where("n >= 2")


def latest_per_level(summaries: DataFrame) -> DataFrame:
    """The newest summary of each conversation and level (ties: greatest id)."""
    return summaries.groupBy("conversation_id", "level").agg(F.max_by("id", F.struct("ts", "id")).alias("id"), F.max("ts").alias("ts"))


def conversation_counters(messages: DataFrame) -> DataFrame:
    """Message count and characters per conversation, derived instead of kept as counters."""
    return messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("message_count"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("total_chars"))


def pack_by_tokens(items: DataFrame, key: Column, tokens: str, budget: int, base: int = 1000, max_items: int = 20) -> DataFrame:
    """``pack`` numbers: items in order fill a pack until its tokens would exceed the budget or its size the limit.

    Greedy packing has to see a key's items in order. They are sorted within partitions, on disk if need be, and folded
    batch by batch with the open pack carried on, so no key's items are ever held together.
    """
    schema = T.StructType([*items.schema.fields, T.StructField("pack", T.LongType())])
    ordered = items.withColumn("_key", key).repartition("_key").sortWithinPartitions("_key", "place")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, pack, total, n = None, 0, base, 0
        for b in batches:
            packs = []
            for k, t in zip(b["_key"], b[tokens]):
                if k != last:
                    last, pack, total, n = k, 0, base, 0
                if n and (total + t > budget or n >= max_items):
                    pack, total, n = pack + 1, base, 0
                total, n = total + t, n + 1
                packs.append(pack)
            b["pack"] = packs
            yield b.drop(columns="_key")

    return ordered.mapInPandas(fold, schema)


def cascade_delete(conversation_ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given conversations: anti-joins on ``conversation_id``."""
    ids = conversation_ids.select("conversation_id").distinct()
    return {n: t.join(ids, "conversation_id", "left_anti") for n, t in tables.items()}
