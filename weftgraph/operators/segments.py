"""Running figures over groups of any size.

A window over a group sorts the group in one task. Here rows are range-partitioned by group and place, so a group that
holds a third of all rows is spread in its own order; figures are computed within (group, segment) and combined with one
row per segment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.session import Scratch


def segmented(rows: DataFrame, keys: Sequence[str], place: Sequence[str], parts: int | None = None) -> DataFrame:
    """Rows with ``_seg``, the number of their range of (keys, place); written, so that a number means one range. Rows
    that have it already stay as they are, so several figures in one order cost one such pass."""
    if "_seg" in rows.columns:
        return rows
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = rows.repartitionByRange(n, *keys, *place).withColumn("_seg", F.spark_partition_id())
    return Scratch(spark, "segments").write(got)


def running_sums(rows: DataFrame, keys: Sequence[str], place: Sequence[str], sums: Mapping[str, Column], parts: int | None = None) -> DataFrame:
    """Rows with a column per name: the sum of its expression over the group's rows up to and with this one.

    ``place`` orders the rows of a group and should do so fully; of rows at one place the order is not defined. Nulls
    add nothing.
    """
    seg = segmented(rows, keys, place, parts)
    inside = W.partitionBy(*keys, "_seg").orderBy(*place).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = seg.groupBy(*keys, "_seg").agg(*(F.coalesce(F.sum(e), F.lit(0)).alias(f"_t_{n}") for n, e in sums.items()))
    before = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*keys, "_seg", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    own = seg.select("*", *(F.coalesce(F.sum(e).over(inside), F.lit(0)).alias(f"_r_{n}") for n, e in sums.items()))
    cond = [own[k].eqNullSafe(starts[k]) for k in (*keys, "_seg")]
    joined = own.join(starts, cond)
    return joined.select(*(own[c] for c in rows.columns), *((F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))


def previous(rows: DataFrame, keys: Sequence[str], place: Sequence[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """Rows with ``out``, the value of the row before in the group; null for the first."""
    seg = segmented(rows, keys, place, parts)
    inside = W.partitionBy(*keys, "_seg").orderBy(*place)
    own = seg.withColumn("_lag", F.lag(value).over(inside)).withColumn("_n", F.row_number().over(inside))
    last = seg.groupBy(*keys, "_seg").agg(F.max_by(value, F.struct(*place)).alias("_last"))
    carried = last.select(*keys, "_seg", F.lag("_last").over(W.partitionBy(*keys).orderBy("_seg")).alias("_carried"))
    joined = own.join(carried, [own[k].eqNullSafe(carried[k]) for k in (*keys, "_seg")])
    return joined.select(*(own[c] for c in rows.columns), F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_lag")).alias(out))
