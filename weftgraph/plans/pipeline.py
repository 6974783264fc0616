"""Scored pipelines: a chain of operations over a row set with a score; every step is a function of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.functions.patterns import compile_filter
from weftgraph.model import Catalog
from weftgraph.operators.retrieval import merge_reranked, vector_topk
from weftgraph.operators.traverse import expand, related_to, with_related
from weftgraph.plans.providers import Generator, generate
from weftgraph.semantics import asc, desc, page

DEFAULT_LIMIT = 10


@dataclass(frozen=True)
class Pipeline:
    """Operations on an entity. The first fetch sets the rows; an empty row set stays empty, a filter never refetches."""

    catalog: Catalog
    entity: str
    ops: tuple[tuple[str, Callable[[DataFrame | None, Pipeline], DataFrame]], ...] = ()
    order: tuple[str, bool] | None = None
    take: int | None = DEFAULT_LIMIT
    skip: int = 0

    def _with(self, name: str, fn: Callable[[DataFrame | None, Pipeline], DataFrame]) -> Pipeline:
        return replace(self, ops=(*self.ops, (name, fn)))

    @property
    def key(self) -> str:
        return self.catalog.entity(self.entity).key

    def _all(self) -> DataFrame:
        return self.catalog.entity(self.entity).with_computed().withColumn("score", F.lit(1.0))

    def fetch_all(self) -> Pipeline:
        return self._with("fetch", lambda df, p: p._all())

    def fetch_ids(self, ids: Sequence[Any]) -> Pipeline:
        return self._with("fetch", lambda df, p: p._all().where(F.col(p.key).isin(list(ids)) if ids else F.lit(False)))

    def where(self, cond: Mapping[str, Any]) -> Pipeline:
        return self._with("filter", lambda df, p: (p._all() if df is None else df).where(compile_filter(cond)))

    def where_in(self, field: str, values: Sequence[Any]) -> Pipeline:
        return self.where({field: {"in": list(values)}})

    def where_pattern(self, field: str, pattern: str) -> Pipeline:
        return self.where({field: {"pattern": pattern}})

    def filter(self, predicate: Callable[[DataFrame], Column]) -> Pipeline:
        return self._with("filter", lambda df, p: (lambda d: d.where(predicate(d)))(p._all() if df is None else df))

    def related_to(self, name: str, anchors: DataFrame, direction: str = "outgoing") -> Pipeline:
        return self._with("filter", lambda df, p: related_to(p._all() if df is None else df, p.key, p.catalog.relationships[name].edges, anchors, direction))

    def semantic(self, query: Sequence[float], top_k: int = 10, minimum: float = 0.0, vec: str = "embedding") -> Pipeline:
        """The most similar rows of those at hand; over earlier scores 0.3 and 0.7 parts, as a first step the plain score."""

        def run(df: DataFrame | None, p: Pipeline) -> DataFrame:
            base = p._all() if df is None else df
            hits = vector_topk(base, F.array(*(F.lit(float(v)) for v in query)), top_k, minimum, id_col=p.key, vec_col=vec)
            hits = hits.select(F.col("id").alias("_id"), F.col("score").alias("_s"))
            new = F.col("_s") if df is None else 0.3 * F.col("score") + 0.7 * F.col("_s")
            return base.join(hits, base[p.key] == hits["_id"]).withColumn("score", new).drop("_id", "_s")

        return self._with("semantic", run)

    def expand(self, name: str, depth: int = 1, direction: str = "outgoing") -> Pipeline:
        def run(df: DataFrame | None, p: Pipeline) -> DataFrame:
            base = p._all() if df is None else df
            paths = expand(base.select(F.col(p.key).alias("id")), p.catalog.relationships[name].edges, depth, direction)
            return with_related(base, p.key, paths)

        return self._with("expand", run)

    def rerank(self, evaluations: DataFrame, strategy: str = "weighted", minimum: float = 0.0) -> Pipeline:
        def run(df: DataFrame | None, p: Pipeline) -> DataFrame:
            base = (p._all() if df is None else df).withColumn("id", F.col(p.key))
            return merge_reranked(base, evaluations, strategy, minimum)

        return self._with("llmRerank", run)

    def structured(self, generator: Generator, fields: Mapping[str, str], merge: str = "append") -> Pipeline:
        return self._with("llmStructured", lambda df, p: generate(p._all() if df is None else df, generator, fields, merge))

    def order_by(self, field: str, ascending: bool = True) -> Pipeline:
        return replace(self, order=(field, ascending))

    def limit(self, n: int | None) -> Pipeline:
        return replace(self, take=n)

    def offset(self, n: int) -> Pipeline:
        return replace(self, skip=n)

    def _run(self, watch: bool) -> tuple[DataFrame, list[tuple[str, Observation]]]:
        df: DataFrame | None = None
        seen = []
        for i, (name, fn) in enumerate(self.ops):
            df = fn(df, self)
            if watch:
                o = Observation(f"{i}-{name}")
                df = df.observe(o, F.count(F.lit(1)).alias("rows"))
                seen.append((name, o))
        df = self._all() if df is None else df
        if self.order:
            df = df.orderBy(asc(self.order[0]) if self.order[1] else desc(self.order[0]), self.key)
        elif self.take is not None or self.skip:
            # without a page the default order would sort everything for nothing
            df = df.orderBy(F.col("score").desc(), self.key)
        return page(df, self.take, self.skip), seen

    def execute(self) -> DataFrame:
        return self._run(False)[0]

    def execute_with_counts(self) -> tuple[DataFrame, list[tuple[str, Observation]]]:
        """The result and, per operation, how many rows left it (known once an action ran)."""
        return self._run(True)

    def count(self) -> DataFrame:
        """The rows of the full predicate, without page."""
        return replace(self, take=None, skip=0)._run(False)[0].agg(F.count(F.lit(1)).alias("n"))
