"""Reading a table that holds one row per version of a node."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ids import pack_uuid


def version_order(updated: str = "updated_at", recorded: str = "recorded_at") -> Column:
    """Greatest for the current row: the latest ``updated_at``; of equal ones the earliest ``recorded_at``."""
    return F.struct(F.col(updated).alias("u"), (-F.unix_micros(F.col(recorded).cast("timestamp"))).alias("r"))


def current_rows(nodes: DataFrame, columns: Sequence[Column], extra: Sequence[Column] = ()) -> DataFrame:
    """One row per uuid: ``id`` (packed), the given columns of its current row, and the aggregates of ``extra``.

    A partial aggregate, not a window: redelivered versions collapse on the map side, and a uuid that holds a large
    part of all rows never forms one sorted group. Rows without uuid are ignored. Should two rows agree in both
    times, the greatest of the columns' values decides, so the result does not depend on row order.
    """
    keep = F.struct(*columns)
    order = F.struct(version_order().alias("o"), keep.alias("k"))
    got = (
        nodes.where(F.length(F.trim("uuid")) > 0)
        .withColumn("id", pack_uuid(F.col("uuid")))
        .groupBy("id")
        .agg(F.max(order).alias("_m"), *extra)
    )
    rest = [c for c in got.columns if c not in ("id", "_m")]
    return got.select("id", "_m.k.*", *rest)
