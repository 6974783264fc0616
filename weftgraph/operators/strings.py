"""Similarity joins of texts by edit distance, without losing a pair.

Two texts within t edits share, if one is cut into t + 1 segments, at least one segment that the other holds at most t
places away (pigeonhole). So texts meet by equal segments, and the edit distance decides. Frequent segments aside, what
is compared grows with the number of texts, not with its square, and a hot segment is a hot join key that AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.semantics import text_similarity

EPS = "0.000000001"


def _edits(length: str, threshold: float) -> str:
    """Edits that a pair may differ by whose longer text has this length."""
    return f"cast(floor((1 - {threshold}D) * {length} + {EPS}D) as int)"


def _segments(rows: DataFrame, threshold: float) -> DataFrame:
    """Segments of each text as the shorter side of a pair, for every length that the longer side may have."""
    longer = F.expr(f"sequence(n, cast(floor(n / {threshold}D + {EPS}D) as int))")
    cut = rows.withColumn("ln", F.explode(longer)).withColumn("t", F.expr(_edits("ln", threshold))).where("ln - t <= n")
    cut = cut.withColumn("i", F.explode(F.expr("sequence(0, t)")))
    start = "cast(floor(i * n / (t + 1)) as int)"
    end = "cast(floor((i + 1) * n / (t + 1)) as int)"
    return cut.withColumn("seg", F.expr(f"substring(text, {start} + 1, {end} - {start})")).select("id", "block", "text", "n", "ln", "i", "seg")


def _probes(rows: DataFrame, threshold: float) -> DataFrame:
    """Substrings of each text as the longer side, at every place where a segment of a shorter one may stand."""
    cut = rows.withColumnRenamed("n", "ln").withColumn("t", F.expr(_edits("ln", threshold)))
    cut = cut.withColumn("n", F.explode(F.expr("sequence(greatest(ln - t, 0), ln)"))).withColumn("i", F.explode(F.expr("sequence(0, t)")))
    start = "cast(floor(i * n / (t + 1)) as int)"
    size = f"(cast(floor((i + 1) * n / (t + 1)) as int) - {start})"
    # a shift to either side is made up for by as many edits, and the lengths differ by ln - n already
    cut = cut.withColumn("at", F.explode(F.expr(f"sequence(greatest({start} - t, 0), greatest(least({start} + t, ln - {size}), greatest({start} - t, 0)))")))
    return cut.withColumn("seg", F.expr(f"substring(text, at + 1, {size})")).select("id", "block", "text", "n", "ln", "i", "seg").distinct()


def _meet(shorter: DataFrame, longer: DataFrame, threshold: float, equal_lengths: bool) -> DataFrame:
    s = _segments(shorter, threshold).select(F.col("id").alias("s_id"), F.col("text").alias("s_text"), "block", "n", "ln", "i", "seg")
    p = _probes(longer, threshold).select(F.col("id").alias("l_id"), F.col("text").alias("l_text"), "block", "n", "ln", "i", "seg")
    j = s.join(p, ["block", "n", "ln", "i", "seg"])
    if not equal_lengths:
        j = j.where("n < ln")
    sim = text_similarity(F.col("s_text"), F.col("l_text"))
    return j.withColumn("similarity", sim).where(F.col("similarity") >= threshold).select("s_id", "l_id", "similarity").distinct()


def _texts(rows: DataFrame, id_col: str, text_col: str, block: Column) -> DataFrame:
    got = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), block.cast("string").alias("block"))
    return got.where("id is not null and text is not null and block is not null").withColumn("n", F.length("text")).where("n > 0")


def similar_pairs(rows: DataFrame, threshold: float, *, id_col: str = "id", text_col: str = "text", block: Column | None = None) -> DataFrame:
    """``a < b, similarity``: rows of one block whose texts are at least so similar. ``rows`` has each text of a block
    once; null and empty texts are similar to none."""
    t = _texts(rows, id_col, text_col, F.lit("") if block is None else block)
    met = _meet(t, t, threshold, True).where("s_id <> l_id")
    return met.select(F.least("s_id", "l_id").alias("a"), F.greatest("s_id", "l_id").alias("b"), "similarity").distinct()


def similar_between(left: DataFrame, right: DataFrame, threshold: float, *, left_id: str, left_text: str, right_id: str, right_text: str) -> DataFrame:
    """``l, r, similarity``: pairs of a row of each side whose texts are at least so similar."""
    a, b = _texts(left, left_id, left_text, F.lit("")), _texts(right, right_id, right_text, F.lit(""))
    one = _meet(a, b, threshold, True).select(F.col("s_id").alias("l"), F.col("l_id").alias("r"), "similarity")
    two = _meet(b, a, threshold, False).select(F.col("l_id").alias("l"), F.col("s_id").alias("r"), "similarity")
    return one.unionByName(two)
