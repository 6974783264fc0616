"""Grouped aggregation and change analytics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.patterns import all_of, predicate
from weftgraph.semantics import desc, sum0

FUNCTIONS = {"COUNT": lambda c: F.count(c), "AVG": F.avg, "SUM": sum0, "MIN": F.min, "MAX": F.max}


def aggregate_entities(
    rows: DataFrame, function: str, field: str | None = None, conditions: Sequence[tuple[str, str, Any]] = (), group_by: str | None = None, limit: int = 100
) -> DataFrame:
    """``result``, or ``group, result`` in descending order of result, at most ``limit`` groups (ties by group)."""
    f = function.upper()
    if f not in FUNCTIONS:
        raise ValueError(f"unknown aggregate: {function}")
    if field is None and f != "COUNT":
        raise ValueError(f"{f} needs a field")
    df = rows.where(all_of([predicate(*c) for c in conditions]))
    value = FUNCTIONS[f](F.lit(1) if field is None else F.col(field)).alias("result")
    if group_by is None:
        return df.agg(value)
    return df.groupBy(F.col(group_by).alias("group")).agg(value).orderBy(desc("result"), F.col("group").asc_nulls_last()).limit(limit)


def bundle(rows: DataFrame, field: str) -> DataFrame:
    """count, min, max, avg and sum of one field in one pass."""
    return rows.agg(F.count(field).alias("count"), F.min(field).alias("min"), F.max(field).alias("max"), F.avg(field).alias("avg"), sum0(field).alias("sum"))


def change_statistics(changes: DataFrame) -> DataFrame:
    """Counts and line sums by change type and entity type with both roll-ups and the total; null marks a roll-up."""
    return (
        changes.groupingSets(
            [["change_type", "entity_type"], ["change_type"], ["entity_type"], []], "change_type", "entity_type"
        )
        .agg(F.count(F.lit(1)).alias("n"), sum0("lines_added").alias("lines_added"), sum0("lines_removed").alias("lines_removed"))
    )


def hotspots(changes: DataFrame, limit: int = 10) -> DataFrame:
    """The entities with most changes and the metadata of their latest change (ties: greatest change id)."""
    latest = F.max_by("metadata", F.struct("ts", "change_id")).alias("latest_metadata")
    return changes.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_changes"), F.max("ts").alias("last_change"), latest).orderBy(F.col("n_changes").desc(), "entity_id").limit(limit)


def histogram(rows: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Counts per value of a domain, 0 where a value does not occur; values outside are not counted."""
    values = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return values.join(counts, column, "left").select(column, F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def project_stats(rows: DataFrame, by: str = "project_id") -> DataFrame:
    """Per project in one pass: rows, errors by type as a map's size, mean retries of those retried, oldest pending."""
    err = F.col("node_state") == "error"
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(err, 1)).alias("n_errors"),
        F.count_distinct(F.when(err, F.coalesce("error_type", F.lit("unknown")))).alias("n_error_types"),
        F.avg(F.when(F.col("retry_count") > 0, F.col("retry_count"))).alias("avg_retries"),
        F.min(F.when(F.col("node_state") == "pending", F.col("updated_at"))).alias("oldest_pending"),
    )


def progress(rows: DataFrame, done: Column) -> DataFrame:
    """``processed, total, percentage``; 100 when there are no rows."""
    n, k = F.count(F.lit(1)), F.count(F.when(done, 1))
    return rows.agg(k.alias("processed"), n.alias("total"), F.when(n == 0, 100).otherwise(F.round(100 * k / n)).cast("long").alias("percentage"))


def coverage(rows: DataFrame, column: str) -> DataFrame:
    """``total, covered, pending, percentage`` of rows with a value; 0 percent of nothing."""
    n, k = F.count(F.lit(1)), F.count(column)
    return rows.agg(n.alias("total"), k.alias("covered"), (n - k).alias("pending"), F.when(n > 0, 100.0 * k / n).otherwise(0.0).alias("percentage"))


def best_per(rows: DataFrame, key: str, score: str = "score") -> DataFrame:
    """The highest score per key."""
    return rows.groupBy(key).agg(F.max(score).alias(score))


def token_estimate(rows: DataFrame, text: str, response_tokens: int = 150, cost_per_1k: float = 0.0) -> DataFrame:
    """Prompt tokens at four characters each, response tokens per row, and their linear cost."""
    prompt = sum0(F.ceil(F.length(text) / 4))
    reply = F.count(F.lit(1)) * response_tokens
    return rows.agg(prompt.cast("long").alias("prompt_tokens"), reply.alias("response_tokens"), ((prompt + reply) * cost_per_1k / 1000).alias("cost"))


def backfill_max(parents: DataFrame, key: str, column: str, children: DataFrame, child_key: str, child_column: str) -> DataFrame:
    """Null values of a parent's column replaced by the greatest value of its children."""
    best = children.groupBy(F.col(child_key).alias("_k")).agg(F.max(child_column).alias("_v"))
    return parents.join(best, parents[key] == best["_k"], "left").withColumn(column, F.coalesce(column, "_v")).drop("_k", "_v")


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, counted on the way: the count is there once an action ran."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("n")), o


def counts_by_label(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``label, n`` over several tables."""
    out = None
    for label, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def members_by(rows: DataFrame, by: Sequence[str], member: str, limit: int = 100) -> DataFrame:
    """Groups with ``n``, their distinct members' number, and ``members``, the first ``limit`` of these in order.

    The limit is applied before the shuffle as well, so no list grows with its group.
    """
    distinct = rows.select(*by, F.col(member).alias("_m")).where("_m is not null").distinct()
    sizes = distinct.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    first = distinct.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_m"))).where(F.col("_r") <= limit)
    lists = first.groupBy(*by).agg(F.array_sort(F.collect_list("_m")).alias("members"))
    return sizes.join(lists, list(by))


def sample_by(rows: DataFrame, by: str, n: int, key: str) -> DataFrame:
    """The first n rows of each value by key: a look at what a label's rows hold. Limited before the shuffle as well."""
    w = W.partitionBy(by).orderBy(key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
