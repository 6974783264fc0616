"""Property graphs as DataFrames: entities, relationships, computed fields, and a catalog of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.ids import sha256_hex


@dataclass(frozen=True)
class Relationship:
    """Edges of one type between two entities: ``edges`` has ``src``, ``dst`` and any properties."""

    name: str
    edges: DataFrame
    source: str
    target: str


@dataclass(frozen=True)
class Entity:
    name: str
    rows: DataFrame
    key: str = "uuid"
    display: str | None = None
    content: str | None = None
    computed: dict[str, str] = field(default_factory=dict)  # SQL expressions

    def with_computed(self, names: Sequence[str] | None = None) -> DataFrame:
        """The rows with the computed fields; a materialised column of the same name wins."""
        df = self.rows
        for n, e in self.computed.items():
            if (names is None or n in names) and n not in df.columns:
                df = df.withColumn(n, F.expr(e))
        return df


@dataclass
class Catalog:
    entities: dict[str, Entity] = field(default_factory=dict)
    relationships: dict[str, Relationship] = field(default_factory=dict)
    filters: dict[str, Callable[..., Column]] = field(default_factory=dict)

    def add(self, *things: Entity | Relationship) -> Catalog:
        for t in things:
            (self.entities if isinstance(t, Entity) else self.relationships)[t.name] = t
        return self

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise KeyError(f"unknown entity: {name}; known: {', '.join(sorted(self.entities))}")
        return self.entities[name]

    def all_nodes(self, *extra: str) -> DataFrame:
        """A label-free scan: ``label``, ``uuid`` and the columns asked for, null where a label lacks them."""
        out = None
        for e in self.entities.values():
            part = e.rows.select(F.lit(e.name).alias("label"), F.col(e.key).cast("string").alias("uuid"), *(c for c in extra if c in e.rows.columns))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def all_edges(self) -> DataFrame:
        out = None
        for r in self.relationships.values():
            part = r.edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(r.name).alias("type"))
            out = part if out is None else out.unionByName(part)
        return out

    def describe(self, name: str) -> dict:
        e = self.entity(name)
        return {
            "entity": name, "key": e.key, "fields": [(f.name, f.dataType.simpleString()) for f in e.rows.schema], "computed": dict(e.computed),
            "relationships": [(r.name, r.source, r.target) for r in self.relationships.values() if name in (r.source, r.target)],
        }


# The types that a declared field may have.
FIELD_TYPES = {
    "string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "datetime": T.TimestampType(), "enum": T.StringType(),
    "array<string>": T.ArrayType(T.StringType()), "array<number>": T.ArrayType(T.DoubleType()),
}


def declared_schema(fields: dict[str, str], required: Sequence[str] = ()) -> T.StructType:
    """A StructType from declared field types; required fields are not nullable."""
    return T.StructType([T.StructField(n, FIELD_TYPES[t], n not in required) for n, t in fields.items()])


def missing_required(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows that lack a required property, with the names of those they lack."""
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)))
    return rows.withColumn("missing", lacking).where(F.size("missing") > 0)


def schema_fingerprint(label: Column, required: Column) -> Column:
    """Twelve hex digits over the label and its sorted required properties."""
    return F.substring(sha256_hex(F.concat(label, F.lit(":"), F.array_join(F.array_sort(required), ","))), 1, 12)
