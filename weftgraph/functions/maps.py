"""Maps and declared types of loose values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.model import FIELD_TYPES


def merge_maps(*maps: Column) -> Column:
    """Maps in one, the last value of a key holds; a null map adds nothing."""
    out = maps[0]
    for m in maps[1:]:
        fresh = F.when(m.isNull(), out).otherwise(F.map_concat(F.map_filter(F.coalesce(out, m), lambda k, v: ~F.map_contains_key(m, k)), m))
        out = F.coalesce(fresh, out)
    return out


def keep_keys(m: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(m, lambda k, v: k.isin(list(keys)))


def drop_keys(m: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(list(keys)))


def to_declared(rows: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Text columns converted to their declared types; a value that is none of its type becomes null. Lists are JSON."""
    def of(name: str) -> Column:
        if name not in fields:
            return F.col(name)
        t = FIELD_TYPES[fields[name]]
        if fields[name].startswith("array"):
            return F.from_json(name, t).alias(name)
        return F.col(name).try_cast(t).alias(name)

    return rows.select(*map(of, rows.columns))
