"""Declarative entity queries: filter, traverse, order, page; an immutable plan that compiles to one DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.patterns import compile_filter, predicate
from weftgraph.model import Catalog
from weftgraph.operators.traverse import one_hop, related_to
from weftgraph.semantics import asc, desc, page


@dataclass(frozen=True)
class QueryPlan:
    catalog: Catalog
    entity: str
    conditions: tuple[tuple[str, str, Any], ...] = ()
    filters: tuple[tuple[str, dict], ...] = ()
    predicates: tuple[Callable[[DataFrame], Column], ...] = ()
    hops: tuple[tuple[str, str, str | None], ...] = ()
    orders: tuple[tuple[str, bool], ...] = ()
    take: int | None = None
    skip: int | None = None
    target: bool = False
    near: tuple[tuple[str, str, Any], ...] = ()
    clauses: tuple[tuple[str, dict], ...] = ()

    def where(self, field: str | Mapping[str, Any], op: str = "=", value: Any = None) -> QueryPlan:
        if isinstance(field, Mapping):
            return replace(self, predicates=(*self.predicates, lambda df, f=field: compile_filter(f)))
        predicate(F.lit(None), op, value if op not in ("IN", "NOT IN") else [value])  # an unknown operator fails here
        return replace(self, conditions=(*self.conditions, (field, op, value)))

    def named_filter(self, name: str, **params: Any) -> QueryPlan:
        if name not in self.catalog.filters:
            raise KeyError(f"unknown filter: {name}")
        return replace(self, filters=(*self.filters, (name, params)))

    def filter(self, fn: Callable[[DataFrame], Column]) -> QueryPlan:
        return replace(self, predicates=(*self.predicates, fn))

    def raw(self, clause: str, **params: Any) -> QueryPlan:
        """A condition in SQL with named parameters (``:name``), which are bound, never spliced."""
        return replace(self, clauses=(*self.clauses, (clause, params)))

    def related_to(self, relationship: str, name: Any, direction: str = "outgoing") -> QueryPlan:
        """Rows with an edge to an entity of that display name: a semi-join, so no row is repeated."""
        return replace(self, near=(*self.near, (relationship, direction, name)))

    def consumes(self, name: Any, relationship: str = "CONSUMES") -> QueryPlan:
        return self.related_to(relationship, name)

    def consumed_by(self, name: Any, relationship: str = "CONSUMES") -> QueryPlan:
        return self.related_to(relationship, name, "incoming")

    def related(self, name: str, direction: str = "outgoing", target: str | None = None) -> QueryPlan:
        return replace(self, hops=(*self.hops, (name, direction, target)))

    def order_by(self, field: str, ascending: bool = True) -> QueryPlan:
        return replace(self, orders=(*self.orders, (field, ascending)))

    def limit(self, n: int) -> QueryPlan:
        return replace(self, take=n)

    def offset(self, n: int) -> QueryPlan:
        return replace(self, skip=n)

    def return_target(self) -> QueryPlan:
        """Give the rows at the end of the traversal instead of those at its start."""
        return replace(self, target=True)

    def compile(self) -> DataFrame:
        """Filters first, so they reach the scan; then one join per hop (a row per path); then order and page."""
        e = self.catalog.entity(self.entity)
        df = e.with_computed()
        for field, op, value in self.conditions:
            df = df.where(predicate(field, op, value))
        for name, params in self.filters:
            df = df.where(self.catalog.filters[name](**params))
        for fn in self.predicates:
            df = df.where(fn(df))
        for clause, params in self.clauses:
            df = df.sparkSession.sql(f"SELECT * FROM {{rows}} WHERE {clause}", args=params or None, rows=df)
        for name, direction, wanted in self.near:
            r = self.catalog.relationships[name]
            other = self.catalog.entity(r.target if direction == "outgoing" else r.source)
            anchors = other.with_computed().where(F.col(other.display or other.key) == wanted).select(F.col(other.key).alias("id"))
            df = related_to(df, e.key, r.edges, anchors, direction)
        if self.hops:
            start, at = df.withColumn("_at", F.col(e.key)), self.entity
            for name, direction, target in self.hops:
                r = self.catalog.relationships[name]
                start = one_hop(start, "_at", r.edges, direction)
                at = r.target if direction == "outgoing" else r.source if direction == "incoming" else (target or (r.target if at == r.source else r.source))
                if target and target != at:
                    return df.where(F.lit(False))
                end = self.catalog.entity(at)
                # a hop counts only if its end exists
                ends = end.rows.select(F.col(end.key).alias("_end"))
                start = start.join(ends, start["_next"] == ends["_end"], "left_semi").drop("_at").withColumnRenamed("_next", "_at")
            if self.target:
                end = self.catalog.entity(at)
                df = start.select(F.col("_at").alias("_k")).join(end.with_computed(), F.col("_k") == F.col(end.key)).drop("_k")
            else:
                df = start.drop("_at")
        if self.orders:
            df = df.orderBy(*(asc(f) if up else desc(f) for f, up in self.orders))
        return page(df, self.take, self.skip)

    def explain(self) -> str:
        """The plan as a sentence; ``compile().explain()`` has Spark's."""
        parts = [f"get {self.entity}"]
        parts += [f"where {f} {op} {v!r}" for f, op, v in self.conditions] + [f"filter {n}" for n, _ in self.filters]
        parts += [f"with {n} {d} {v!r}" for n, d, v in self.near] + [f"where {c}" for c, _ in self.clauses]
        parts += [f"follow {n} {d}" + (f" to {t}" if t else "") for n, d, t in self.hops]
        parts += [f"order by {f} {'ascending' if up else 'descending'}" for f, up in self.orders]
        parts += [f"skip {self.skip}"] if self.skip else []
        parts += [f"take {self.take}"] if self.take is not None else []
        return ", then ".join(parts)


def get(catalog: Catalog, entity: str) -> QueryPlan:
    catalog.entity(entity)
    return QueryPlan(catalog, entity)
