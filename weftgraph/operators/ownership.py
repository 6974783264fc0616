"""Projects and what belongs to them: exclusion, re-homing by path, matching, access times, cleaning up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def below(path: Column, root: str) -> Column:
    """At a folder or below it; false for null."""
    return F.coalesce((path == root) | F.startswith(path, F.lit(root.rstrip("/") + "/")), F.lit(False))


def set_excluded(projects: DataFrame, ids: Sequence[str], excluded: bool | None) -> DataFrame:
    """The projects' exclusion set, or with None toggled; a null flag means included."""
    now = F.coalesce("is_excluded", F.lit(False))
    hit = F.coalesce(F.col("project_id").isin(list(ids)), F.lit(False))
    return projects.withColumn("is_excluded", F.when(hit, ~now if excluded is None else F.lit(excluded)).otherwise(F.col("is_excluded")))


def _moved(nodes: DataFrame, take: Column, new_path: Column, project: str, path: str) -> DataFrame:
    new = {path: new_path, "project_id": F.lit(project)}
    return nodes.select(*(F.when(take, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in nodes.columns))


def rehome(nodes: DataFrame, orphan_project: str, project: str, root: str, path: str = "source_path") -> DataFrame:
    """Nodes of the project of orphans that lie below a root become the project's, with paths relative to the root."""
    take = (F.col("project_id") == orphan_project) & below(F.col(path), root)
    rest = F.substring(F.col(path), F.lit(len(root.rstrip("/")) + 2), F.length(path))
    return _moved(nodes, take, rest, project, path)


def merge_project(nodes: DataFrame, child: str, parent: str, prefix: str, path: str = "source_path") -> DataFrame:
    """A child project's nodes become its parent's; their relative paths get the child's place in the parent."""
    take = F.coalesce(F.col("project_id") == child, F.lit(False))
    moved = F.concat(F.lit(prefix.rstrip("/") + "/"), F.col(path))
    return _moved(nodes, take, moved, parent, path)


def matching_projects(projects: DataFrame, path: str) -> DataFrame:
    """Projects whose root holds the path or lies below it, the deepest root first (ties by id)."""
    root = F.regexp_replace("root_path", "/$", "")
    p = path.rstrip("/")
    holds = F.lit(p).startswith(F.concat(root, F.lit("/"))) | (root == p)
    return projects.where(holds | below(root, p)).orderBy(F.length(root).desc(), "project_id")


def touch(rows: DataFrame, paths: Sequence[str], when: Column, path: str = "source_path", column: str = "last_access") -> DataFrame:
    """The given paths get an access time; the column is added if there is none."""
    old = F.col(column) if column in rows.columns else F.lit(None).cast("timestamp")
    return rows.withColumn(column, F.when(F.col(path).isin(list(paths)), when).otherwise(old))


def pending_counts(rows: DataFrame, state: str = "node_state", path: str = "source_path") -> DataFrame:
    """``project_id, state, n_nodes, n_files`` of rows that are not finished."""
    open_ = rows.where(~F.coalesce(F.col(state).isin("ready", "skip"), F.lit(False)))
    return open_.groupBy("project_id", F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct(path).alias("n_files"))


def delete_projects(nodes: DataFrame, edges: DataFrame, projects: DataFrame, ids: Sequence[str], key: str = "uuid") -> dict[str, DataFrame]:
    """Tables without the projects, their nodes and what touches these, and ``deleted`` (``project_id, n_nodes, existed``)."""
    gone = F.coalesce(F.col("project_id").isin(list(ids)), F.lit(False))
    dead = nodes.where(gone).select(F.col(key).alias("_g")).distinct()
    asked = projects.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "project_id string")
    n = nodes.where(gone).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    known = projects.where(gone).select("project_id", F.lit(True).alias("existed")).distinct()
    return {
        "nodes": nodes.where(~gone),
        "edges": edges.join(dead, F.col("src") == F.col("_g"), "left_anti").join(dead, F.col("dst") == F.col("_g"), "left_anti"),
        "projects": projects.where(~gone),
        "deleted": asked.join(n, "project_id", "left").join(known, "project_id", "left").select("project_id", F.coalesce("n_nodes", F.lit(0)).cast("long").alias("n_nodes"), F.coalesce("existed", F.lit(False)).alias("existed")),
    }


def garbage(nodes: DataFrame, projects: DataFrame, chunks: DataFrame | None = None, before: Column | None = None, key: str = "uuid") -> dict[str, DataFrame]:
    """What a collection would remove: ``nodes`` without a project, ``chunks`` (``chunk_id, parent``) without their parent,
    and ``projects`` without nodes or, with ``before``, not accessed since."""
    out = {"nodes": nodes.join(projects.select("project_id").distinct(), "project_id", "left_anti")}
    if chunks is not None:
        out["chunks"] = chunks.join(nodes.select(F.col(key).alias("_n")), F.col("parent") == F.col("_n"), "left_anti")
    empty = projects.join(nodes.select("project_id").distinct().withColumn("_has", F.lit(True)), "project_id", "left")
    stale = F.col("_has").isNull()
    if before is not None:
        stale = stale | F.coalesce(F.col("last_accessed") < before, F.lit(False))
    return out | {"projects": empty.where(stale).drop("_has")}
