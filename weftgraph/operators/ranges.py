"""Points in ranges, within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containing_ranges(points: DataFrame, ranges: DataFrame, group: str, at: str, start: str, end: str) -> DataFrame:
    """Each point with every range of its group that holds it (ends included): all columns of both.

    A range belongs to the level of the least power of two that is not below its length, and lies in at most two
    buckets of that width; a point is looked for in one bucket per level that occurs. So within a group only ranges
    about a point are compared with it, where the group alone as key would pair all with all. Points, starts and ends
    that are null, and ranges that end before they start, meet nothing. Columns of the two sides must differ but for
    the group.
    """
    level = F.ceil(F.log2((F.col(end) - F.col(start) + 1).cast("double"))).cast("int")
    r = ranges.where(F.col(end) >= F.col(start)).withColumn("_level", level)
    width = F.expr("shiftleft(1L, _level)")
    r = r.withColumn("_bucket", F.explode(F.array_distinct(F.array(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))))
    # at most 64 numbers
    levels = r.agg(F.array_sort(F.collect_set("_level"))).head()[0]
    p = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    p = p.withColumn("_bucket", F.floor(F.col(at) / F.expr("shiftleft(1L, _level)")))
    return p.join(r, [group, "_level", "_bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_bucket")
