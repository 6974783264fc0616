"""Bounded draws of rows that models are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = 1 << 40


def bounded_sample(rows: DataFrame, key: Column, bound: int, n: int) -> DataFrame:
    """At most ``bound`` of the ``n`` rows, drawn by the key's hash, so the draw does not depend on how rows are stored.

    A filter, not an ordered limit: that would send each partition's best ``bound`` rows to the driver, which grows with
    the number of partitions. The share aims a little below the bound, which the limit then never cuts in practice.
    """
    if n <= bound:
        return rows.limit(bound)
    share = max(0.0, bound - 7 * bound**0.5) / n
    return rows.where(F.pmod(F.xxhash64(key), F.lit(SPACE)) < int(share * SPACE)).limit(bound)
