"""Incremental ETL: snapshot diffs, upserts, deletes, state machines, garbage collection. Tables are rewritten, never mutated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of a node and the states each may change to.
TRANSITIONS: dict[str, tuple[str, ...]] = {
    "pending": ("parsing", "skip"),
    "parsing": ("parsed", "error"),
    "parsed": ("linking",),
    "linking": ("linked", "error"),
    "linked": ("entities", "skip"),
    "entities": ("embedding", "error"),
    "embedding": ("ready", "error"),
    "ready": ("pending",),
    "skip": ("pending",),
    "error": ("pending",),
}
IN_PROGRESS = ("parsing", "linking", "entities", "embedding")
MAX_RETRIES = 3


def classify_changes(old: DataFrame, new: DataFrame, key: str, digest: str, fingerprint: str | None = None) -> DataFrame:
    """``key, change``: created, updated, unchanged or deleted, by one full outer join. A changed fingerprint is an update."""
    cols = [digest] + ([fingerprint] if fingerprint else [])
    o = old.select(F.col(key).alias("_ok"), *(F.col(c).alias(f"_o{c}") for c in cols))
    n = new.select(F.col(key).alias("_nk"), *(F.col(c).alias(f"_n{c}") for c in cols))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"_o{c}").eqNullSafe(F.col(f"_n{c}"))
    change = F.when(F.col("_ok").isNull(), "created").when(F.col("_nk").isNull(), "deleted").when(same, "unchanged").otherwise("updated")
    return o.join(n, F.col("_ok") == F.col("_nk"), "full").select(F.coalesce("_nk", "_ok").alias(key), change.alias("change"))


def merge_patch(rows: DataFrame, patch: DataFrame, key: str, insert: bool = False) -> DataFrame:
    """Rows with a patch's values that are not null laid over theirs; with ``insert`` unknown keys are added."""
    cols = [c for c in rows.columns if c != key]
    p = patch.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_p_{c}") for c in cols if c in patch.columns))
    j = rows.join(p, rows[key] == p["_k"], "full" if insert else "left")
    return j.select(
        F.coalesce(rows[key], F.col("_k")).alias(key),
        *(F.coalesce(F.col(f"_p_{c}"), rows[c]).alias(c) if c in patch.columns else rows[c] for c in cols),
    )


def unknown_keys(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Keys of a patch that no row has: what a strict update must refuse."""
    return patch.join(rows.select(key), key, "left_anti").select(key)


def delete_detach(nodes: DataFrame, edges: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the given ids and what touches them; unknown ids do nothing."""
    gone = ids.select(F.col(key).alias("_g")).distinct()
    return (
        nodes.join(gone, nodes[key] == gone["_g"], "left_anti"),
        edges.join(gone, edges["src"] == gone["_g"], "left_anti").join(gone, F.col("dst") == gone["_g"], "left_anti"),
    )


def merge_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges with new ones merged in: each (src, dst, type) once, and only where both ends exist."""
    ids = nodes.select(F.col(key).alias("_n"))
    ok = new.join(ids, new["src"] == ids["_n"], "left_semi").join(ids, F.col("dst") == ids["_n"], "left_semi")
    return edges.select("src", "dst", "type").unionByName(ok.select("src", "dst", "type")).distinct()


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges created without merging: duplicates are allowed."""
    return edges.unionByName(new, allowMissingColumns=True)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst", "type").distinct(), ["src", "dst", "type"], "left_anti")


def delete_for_files(nodes: DataFrame, paths: DataFrame, columns: Sequence[str] = ("file", "path", "source_path")) -> DataFrame:
    """Nodes of none of the files: an anti-join per path column."""
    p = paths.select(F.col("path").alias("_p")).distinct()
    for c in columns:
        if c in nodes.columns:
            nodes = nodes.join(p, nodes[c] == p["_p"], "left_anti")
    return nodes


def orphans(children: DataFrame, fk: str, parents: DataFrame, pk: str) -> DataFrame:
    """Children whose parent does not exist."""
    return children.join(parents.select(F.col(pk).alias("_p")), children[fk] == F.col("_p"), "left_anti")


def collect_garbage(nodes: DataFrame, projects: DataFrame, edges: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Nodes of existing projects, and the edges between them."""
    kept = nodes.join(projects.select("project_id").distinct(), "project_id", "left_semi")
    ids = kept.select(F.col(key).alias("_n"))
    return kept, edges.join(ids, edges["src"] == ids["_n"], "left_semi").join(ids, F.col("dst") == ids["_n"], "left_semi")


def stale_mentions(before: DataFrame, after: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions that are gone, and entities that nothing mentions any more."""
    pair = ["src", "dst"]
    gone = before.select(*pair).distinct().join(after.select(*pair), pair, "left_anti")
    left = entities.join(after.select(F.col("dst").alias("_d")), entities["id"] == F.col("_d"), "left_anti")
    return gone, left


def transition_pairs(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "from_state string, to_state string")


def invalid_transitions(rows: DataFrame, from_col: str = "from_state", to_col: str = "to_state") -> DataFrame:
    """Rows whose change of state the table of transitions does not allow."""
    t = transition_pairs(rows.sparkSession).select(F.col("from_state").alias("_f"), F.col("to_state").alias("_t"))
    return rows.join(F.broadcast(t), (rows[from_col] == t["_f"]) & (rows[to_col] == t["_t"]), "left_anti")


def apply_transition(rows: DataFrame, state: str, key: str, wanted: DataFrame) -> DataFrame:
    """Rows moved to the wanted states (``key, to_state``) where that is allowed; the others stay."""
    t = transition_pairs(rows.sparkSession)
    j = rows.join(wanted.select(F.col(key).alias("_k"), "to_state"), rows[key] == F.col("_k"), "left")
    ok = j.join(F.broadcast(t.select("from_state", F.col("to_state").alias("_t"), F.lit(True).alias("_ok"))), (j[state] == F.col("from_state")) & (j["to_state"] == F.col("_t")), "left")
    return ok.withColumn(state, F.when(F.col("_ok"), F.col("to_state")).otherwise(F.col(state))).select(*rows.columns)


def retryable(rows: DataFrame, state: str = "node_state", retries: str = "retry_count", limit: int = MAX_RETRIES) -> DataFrame:
    """Rows in error with tries left."""
    return rows.where((F.col(state) == "error") & (F.coalesce(retries, F.lit(0)) < limit))


def retry_queue(rows: DataFrame, n: int, state: str = "node_state", retries: str = "retry_count", updated: str = "updated_at", key: str = "uuid") -> DataFrame:
    """The next n rows to try again: tried least first, then longest waiting (ties by key)."""
    return retryable(rows, state, retries).orderBy(F.coalesce(retries, F.lit(0)), updated, key).limit(n)


def stuck(rows: DataFrame, now: datetime | Column, minutes: int = 5, state: str = "node_state", updated: str = "updated_at") -> DataFrame:
    """Rows in a working state that were not touched for so many minutes."""
    t = now if isinstance(now, Column) else F.lit(now)
    return rows.where(F.col(state).isin(*IN_PROGRESS) & (F.col(updated) < t - F.expr(f"INTERVAL {minutes} MINUTES")))


def recover(rows: DataFrame, state: str = "node_state", retries: str = "retry_count") -> DataFrame:
    """After a crash: working states start over, errors with tries left are tried again."""
    again = F.col(state).isin(*IN_PROGRESS) | ((F.col(state) == "error") & (F.coalesce(retries, F.lit(0)) < MAX_RETRIES))
    return rows.withColumn(state, F.when(again, "pending").otherwise(F.col(state)))


def project_of_path(paths: DataFrame, projects: DataFrame, longest: bool = False) -> DataFrame:
    """``path, project_id``: the project whose root holds the path; the one accessed last, or with ``longest`` the deepest.

    A path's own ancestors are exploded and joined by equality, where a prefix condition would pair all with all.
    """
    from weftgraph.operators.traverse import path_ancestors

    p = paths.select("path").distinct().withColumn("root", F.explode(F.array_append(path_ancestors(F.col("path")), F.col("path"))))
    r = projects.select("project_id", F.regexp_replace("root_path", "/$", "").alias("root"), "last_accessed")
    order = F.struct(F.length("root"), "last_accessed", "project_id") if longest else F.struct("last_accessed", F.length("root"), "project_id")
    return p.join(r, "root").groupBy("path").agg(F.max_by("project_id", order).alias("project_id"))


def directories_of(paths: DataFrame) -> DataFrame:
    """``path, parent, depth`` of every directory above the given file paths."""
    from weftgraph.operators.traverse import path_ancestors

    d = paths.select(F.explode(path_ancestors(F.col("path"))).alias("path")).distinct()
    parent = F.regexp_replace("path", "/[^/]*$", "")
    return d.select("path", F.when(parent != "", parent).alias("parent"), (F.size(F.split("path", "/")) - 1).alias("depth"))


def needs_embedding(rows: DataFrame, stored: DataFrame, key: str, digest: str, model: str) -> DataFrame:
    """``key, reason``: no embedding yet, other content, or another model."""
    s = stored.select(F.col(key).alias("_k"), F.col(digest).alias("_d"), F.col("model").alias("_m"))
    reason = F.when(F.col("_k").isNull(), "missing").when(~F.col("_d").eqNullSafe(F.col(digest)), "content").when(~F.col("_m").eqNullSafe(F.lit(model)), "model")
    return rows.join(s, rows[key] == s["_k"], "left").select(key, reason.alias("reason")).where("reason is not null")


def clear_columns(rows: DataFrame, columns: Sequence[str], where: Column) -> DataFrame:
    """Columns set to null where the condition holds."""
    return rows.select(*(F.when(~F.coalesce(where, F.lit(False)), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def link_by_tiers(rows: DataFrame, targets: DataFrame, tiers: Sequence[Mapping[str, str]], key: str) -> DataFrame:
    """``key, id, tier``: each row's target by the first tier (a pair of equal columns) that finds one."""
    out = None
    for n, pair in enumerate(tiers, 1):
        (a, b), = pair.items()
        first = targets.groupBy(F.col(b).alias("_b")).agg(F.min("id").alias("id"))  # one row per value before the join
        part = rows.select(F.col(key), F.col(a).alias("_a")).join(first, F.col("_a") == F.col("_b")).select(key, "id", F.lit(n).alias("tier"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.min(F.struct("tier", "id")).alias("m")).select(key, "m.id", "m.tier")


def entity_history(changes: DataFrame, entity: Column, limit: int = 10) -> DataFrame:
    return changes.where(F.col("entity_id") == entity).orderBy(F.col("ts").desc(), F.col("change_id").desc()).limit(limit)


def recent_changes(changes: DataFrame, types: Sequence[str] | None = None, limit: int = 20) -> DataFrame:
    df = changes if types is None else changes.where(F.col("entity_type").isin(list(types)))
    return df.orderBy(F.col("ts").desc(), F.col("change_id").desc()).limit(limit)


def changes_between(changes: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive at both ends."""
    return changes.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def line_diff(rows: DataFrame, old: str, new: str) -> DataFrame:
    """``change_type, lines_added, lines_removed`` per row; created and deleted texts need no diff, updates use Arrow batches."""
    @F.pandas_udf("added long, removed long")
    def diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        import difflib

        out = []
        for x, y in zip(a, b):
            ls = list(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), n=0, lineterm=""))[2:]
            out.append((sum(s[:1] == "+" for s in ls), sum(s[:1] == "-" for s in ls)))
        return pd.DataFrame(out, columns=["added", "removed"])

    lines = lambda c: F.size(F.split(c, "\n", -1)).cast("long")
    kind = F.when(F.col(old).isNull(), "created").when(F.col(new).isNull(), "deleted").when(F.col(old) == F.col(new), "unchanged").otherwise("updated")
    df = rows.withColumn("change_type", kind)
    d = F.when(F.col("change_type") == "updated", diff(F.col(old), F.col(new)))
    return df.withColumn("_d", d).withColumn(
        "lines_added", F.when(F.col("change_type") == "created", lines(new)).when(F.col("change_type") == "updated", F.col("_d.added")).otherwise(0).cast("long")
    ).withColumn(
        "lines_removed", F.when(F.col("change_type") == "deleted", lines(old)).when(F.col("change_type") == "updated", F.col("_d.removed")).otherwise(0).cast("long")
    ).drop("_d")
