"""Where graph-query semantics differ from Spark's defaults; each rule is stated once, here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asc(c: str | Column) -> Column:
    """Ascending order in which null is the largest value."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: str | Column) -> Column:
    """Descending order in which null is the largest value."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def full_match(c: Column, pattern: str) -> Column:
    """Whole-string regular expression match; ``rlike`` alone finds a part."""
    return c.rlike(f"^(?:{pattern})$")


def sum0(c: str | Column) -> Column:
    """A sum that is 0 over no rows."""
    return F.coalesce(F.sum(c), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, normalized: bool = False) -> Column:
    """Cosine similarity; 0 if lengths differ or a norm is 0. ``normalized`` maps it to 0..1."""
    n = norm(a) * norm(b)
    c = F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)
    return (1 + c) / 2 if normalized else c


def euclidean_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + distance); 0 if lengths differ."""
    d2 = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(1 / (1 + F.sqrt(d2)))


def text_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 if one is empty, else 1 - distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def page(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Skip, then take; 0 is a limit like any other."""
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
