"""The public functions that applications call by name, over a catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.patterns import all_of, convert_operator, glob_field, predicate
from weftgraph.model import Catalog
from weftgraph.operators.aggregate import aggregate_entities
from weftgraph.operators.etl import changes_between, entity_history, recent_changes
from weftgraph.operators.retrieval import fuzzy_words, grep, vector_topk
from weftgraph.operators.traverse import dependency_hierarchy, neighbours_by_relation
from weftgraph.semantics import asc, desc, page
from weftgraph.operators.crawl import site_graph
from weftgraph.operators.ownership import delete_projects, garbage, set_excluded, touch
from weftgraph.operators.search import search
from weftgraph.sources.files import data_file_references, globbed, read_tree, run_sql

def query_entities(catalog: Catalog, entity: str, conditions: Sequence[tuple[str, str, Any]] = (), order: Sequence[tuple[str, bool]] = (), limit: int | None = 10, offset: int = 0, fields: Sequence[str] | None = None) -> DataFrame:
    e = catalog.entity(entity)
    df = e.with_computed().where(all_of([predicate(f, *convert_operator(op, v)) for f, op, v in conditions]))
    df = df.orderBy(*(asc(f) if up else desc(f) for f, up in order), e.key)
    df = page(df, limit, offset)
    return df.select(*fields) if fields else df


def get_entities_by_ids(catalog: Catalog, entity: str, ids: Sequence[Any], fields: Sequence[str] | None = None) -> DataFrame:
    e = catalog.entity(entity)
    df = e.rows.where(F.col(e.key).isin(list(ids)) if ids else F.lit(False))
    return df.select(*(fields or [c for c in (e.key, e.display, e.content) if c]))


def get_entity_by_id(catalog: Catalog, entity: str, id_: Any) -> DataFrame:
    e = catalog.entity(entity)
    return e.with_computed().where(F.col(e.key) == id_)


def glob_search(catalog: Catalog, entity: str, field: str, glob: str, limit: int | None = 50) -> DataFrame:
    e = catalog.entity(entity)
    return page(e.rows.where(F.col(field).rlike(glob_field(glob))).orderBy(e.key), limit)


def semantic_search(catalog: Catalog, entity: str, query: Sequence[float], top_k: int = 10, minimum: float = 0.0, vec: str = "embedding") -> DataFrame:
    e = catalog.entity(entity)
    return vector_topk(e.rows, F.array(*(F.lit(float(v)) for v in query)), top_k, minimum, id_col=e.key, vec_col=vec)


def explore_relationships(catalog: Catalog, node_id: Any, depth: int = 1, limit: int = 20) -> DataFrame:
    return neighbours_by_relation(str(node_id), catalog.all_edges(), depth, limit)


def extract_dependency_hierarchy(catalog: Catalog, roots: DataFrame, consumes: str, inherits: str, depth: int = 2, per_branch: int | None = None) -> DataFrame:
    r = catalog.relationships
    return dependency_hierarchy(roots, r[consumes].edges, r[inherits].edges, depth, per_branch)


def list_projects(projects: DataFrame, nodes: DataFrame) -> DataFrame:
    """Projects with the number of their nodes, 0 where there are none."""
    n = nodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return projects.join(n, "project_id", "left").withColumn("n_nodes", F.coalesce("n_nodes", F.lit(0)))


def get_schema(catalog: Catalog) -> dict[str, Any]:
    return {n: catalog.describe(n) for n in catalog.entities}


def mark_dirty(rows: DataFrame, paths: Sequence[str], path: str = "source_path", state: str = "node_state") -> DataFrame:
    return rows.withColumn(state, F.when(F.col(path).isin(list(paths)), "pending").otherwise(F.col(state)))


def forget_path(rows: DataFrame, base: str, path: str = "source_path") -> DataFrame:
    """Rows that do not lie at or below a path."""
    below = (F.col(path) == base) | F.startswith(F.col(path), F.lit(base.rstrip("/") + "/"))
    return rows.where(~F.coalesce(below, F.lit(False)))


def tool_table() -> Mapping[str, Any]:
    """Every tool by its name."""
    return {
        "brain_search": search, "analyze_files": data_file_references, "cleanup_brain": garbage, "ingest_web_page": site_graph, "list_tables": lambda catalog: sorted(catalog.entities),
        "describe_table": lambda catalog, name: catalog.describe(name), "touch": touch, "exclude_project": set_excluded, "delete_project": delete_projects,
        "query_entities": query_entities, "get_entity_by_id": get_entity_by_id, "get_entities_by_ids": get_entities_by_ids, "glob_search": glob_search,
        "semantic_search": semantic_search, "explore_relationships": explore_relationships, "extract_dependency_hierarchy": extract_dependency_hierarchy,
        "aggregate_entities": aggregate_entities, "entity_history": entity_history, "recent_changes": recent_changes, "changes_between": changes_between,
        "list_projects": list_projects, "get_schema": get_schema, "mark_dirty": mark_dirty, "forget_path": forget_path, "grep_files": grep,
        "search_files": fuzzy_words, "glob_files": globbed, "ingest_directory": read_tree, "run_query": run_sql,
    }
