"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ids import pack_uuid, unpack_uuid
from weftgraph.operators.versions import current_rows
from weftgraph.session import Scratch

SEPARATOR = "/"


def live_nodes(nodes: DataFrame, names: bool = False) -> DataFrame:
    """Live nodes by their current rows: ``id, pid, node_depth`` and, on request, ``name``."""
    cols = [
        pack_uuid(F.col("parent_uuid")).alias("pid"),
        F.col("node_depth"),
        F.col("deleted_at").isNull().alias("live"),
    ]
    if names:
        cols.append(F.coalesce("node_name", F.lit("")).alias("name"))
    return current_rows(nodes, cols).where("live").drop("live")


def resolve_hierarchy(
    links: DataFrame, scratch: Scratch, *, ancestors: bool = False, names: bool = False
) -> DataFrame:
    """For every node its root and real depth; optionally the chain of ancestors and the path of names.

    ``links`` has ``id`` (unique), ``pid`` (null for none) and, with ``names``, ``name``; its other columns pass
    through. A pid that is no id counts as none. Result: ``links`` plus ``root`` and ``real_depth``; nodes on a cycle
    or below one have a null root and depth -1. ``ancestors`` adds the ids from the root to the parent, ``names`` the
    names from the root to the node joined by ``/`` (null on cycles). An empty input gives an empty result.

    Only inner nodes take part in the doubling: each round joins a node's pointer with the pointer of where it points,
    which doubles the distance covered, and nodes that reached a root drop out of the left side. A round in which none
    reaches its root proves that all that is left hangs on cycles, since an acyclic rest always has a node within the
    next doubled distance. So the rounds are the logarithm of the depth plus one. Leaves take their parent's result in
    one last join. Both sides of every join are keyed by a unique id on the right, so AQE can split a hot left key.
    """
    links = scratch.write(links, "links")
    spare = [c for c, on in (("name", names),) if on]
    parents = links.where("pid is not null").groupBy("pid").agg(F.lit(1).alias("_p")).select(F.col("pid").alias("id"))
    inner = scratch.write(links.select("id", "pid", *spare).join(parents, "id", "left_semi"), "inner")

    def payload(chain, path):
        return ([chain.alias("chain")] if ancestors else []) + ([path.alias("path")] if names else [])

    # chain: ids from (and with) the pointer's target to the node, without the node; path: names after the target
    up = inner.select(F.col("id").alias("up_id"))
    start = inner.join(up, inner.pid == up.up_id, "left")
    is_root = F.col("up_id").isNull()
    none = F.array().cast("array<binary>")
    state = scratch.write(
        start.select(
            "id",
            F.when(is_root, F.col("id")).otherwise(F.col("pid")).alias("anc"),
            F.when(is_root, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("dist"),
            is_root.alias("done"),
            *payload(F.when(is_root, none).otherwise(F.array("pid")), F.col("name") if names else F.lit("")),
        ),
        "start",
    )
    done, todo = [state.where("done")], state.where("not done")
    held = [state]
    left = todo.count()
    while left:
        a = todo.alias("a")
        known = todo
        for d in done:
            known = known.unionByName(d)
        b = known.alias("b")
        step = (
            a.join(b, F.col("a.anc") == F.col("b.id"))
            .select(
                F.col("a.id").alias("id"),
                F.col("b.anc").alias("anc"),
                (F.col("a.dist") + F.col("b.dist")).alias("dist"),
                F.col("b.done").alias("done"),
                *payload(
                    F.concat("b.chain", "a.chain") if ancestors else None,
                    F.concat_ws(SEPARATOR, F.col("b.path"), F.col("a.path")) if names else None,
                ),
            )
        )
        new = scratch.write(step, "round")
        ended, total = new.agg(F.count(F.when(F.col("done"), 1)), F.count(F.lit(1))).head()
        held.append(new)
        if not ended:
            todo = new
            break
        done.append(new.where("done"))
        todo, left = new.where("not done"), total - ended

    result = todo.withColumn("anc", F.lit(None).cast("binary"))
    for d in done:
        result = result.unionByName(d)
    result = result.select(
        F.col("id").alias("_pid"), F.col("anc").alias("_root"), F.col("dist").alias("_dist"),
        *([F.col("chain").alias("_chain")] if ancestors else []), *([F.col("path").alias("_path")] if names else []),
    )
    result = scratch.write(result, "resolved")
    for t in (*held, inner):
        scratch.drop(t)
    found = F.col("_pid").isNotNull()
    cyclic = found & F.col("_root").isNull()
    out = links.join(result, links.pid == result["_pid"], "left")
    cols = [
        *links.columns,
        F.when(found, F.col("_root")).otherwise(F.col("id")).alias("root"),
        F.when(cyclic, F.lit(-1)).when(found, F.col("_dist") + 1).otherwise(F.lit(0)).cast("bigint").alias("real_depth"),
    ]
    if ancestors:
        whole = F.concat("_chain", F.array("_pid"))
        cols.append(F.when(cyclic, F.lit(None)).when(found, whole).otherwise(none).alias("ancestors"))
    if names:
        path = F.concat_ws(SEPARATOR, "_path", "name")
        cols.append(F.when(cyclic, F.lit(None)).when(found, path).otherwise(F.col("name")).alias("path"))
    return out.select(*cols)


def descendants(resolved: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) of a result with ``ancestors``: one row per pair, cycles excluded."""
    return resolved.select(
        F.col("id").alias("descendant"), F.size("ancestors").alias("_n"), F.posexplode("ancestors").alias("_i", "ancestor")
    ).select("ancestor", "descendant", (F.col("_n") - F.col("_i")).cast("bigint").alias("distance"))


def descendant_counts(resolved: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, n_descendants`` of the nodes with children in a written result; nodes on or below a cycle are left out.

    Doubling again: each inner node starts with its children's number and a pointer to its parent, and in every round
    gives its sum to where it points and moves the pointer as far again. After k rounds a sum covers the subtree down to
    2^k inner levels, so a chain of any length takes logarithmic rounds and no node's descendants are ever listed.
    """
    ok = resolved.where("real_depth >= 0")
    kids = ok.where("real_depth > 0").groupBy("pid").agg(F.count(F.lit(1)).alias("n")).select(F.col("pid").alias("id"), "n")
    parent = F.when(F.col("real_depth") > 0, F.col("pid")).alias("up")
    state = scratch.write(ok.select("id", parent).join(kids, "id"), "counts")
    while state.where("up is not null").head(1):
        given = state.where("up is not null").groupBy("up").agg(F.sum("n").alias("_n")).select(F.col("up").alias("_id"), "_n")
        above = state.select(F.col("id").alias("_up"), F.col("up").alias("_next"))
        moved = state.join(above, F.col("up") == F.col("_up"), "left").select("id", F.col("_next").alias("up"), "n")
        step = moved.join(given, F.col("id") == F.col("_id"), "left").select("id", "up", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
        last, state = state, scratch.write(step, "counts")
        scratch.drop(last)
    return state.select("id", F.col("n").alias("n_descendants"))


def misplaced_nodes(nodes: DataFrame) -> DataFrame:
    """Live nodes on or below a cycle, and those whose stored depth is null or wrong: ``uuid, root_uuid, real_depth``."""
    scratch = Scratch(nodes.sparkSession, "hierarchy")
    r = resolve_hierarchy(live_nodes(nodes), scratch)
    wrong = F.col("node_depth").isNull() | (F.col("node_depth") != F.col("real_depth")) | (F.col("real_depth") == -1)
    return r.where(wrong).select(
        unpack_uuid(F.col("id")).alias("uuid"),
        F.coalesce(unpack_uuid(F.col("root")), F.lit("")).alias("root_uuid"),
        "real_depth",
    )


def all_descendants(nodes: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance``: every live node with each live node below it; nodes on or below a cycle have none."""
    scratch = Scratch(nodes.sparkSession, "hierarchy")
    pairs = descendants(resolve_hierarchy(live_nodes(nodes), scratch, ancestors=True))
    return pairs.select(unpack_uuid(F.col("ancestor")).alias("ancestor"), unpack_uuid(F.col("descendant")).alias("descendant"), "distance")


def full_hierarchy(nodes: DataFrame, ancestors: bool = True) -> DataFrame:
    """Every live node with path of names, real depth, root, number of descendants and, if asked for, its parent chain
    (``ancestors`` from the root to the parent, null on or below a cycle)."""
    scratch = Scratch(nodes.sparkSession, "hierarchy")
    r = scratch.write(resolve_hierarchy(live_nodes(nodes, names=True), scratch, ancestors=ancestors, names=True), "whole")
    below = descendant_counts(r.select("id", "pid", "real_depth"), scratch).withColumnRenamed("id", "_id")
    return r.join(below, r.id == F.col("_id"), "left").select(
        unpack_uuid(F.col("id")).alias("uuid"),
        F.coalesce(unpack_uuid(F.col("root")), F.lit("")).alias("root_uuid"),
        "real_depth",
        "path",
        *([F.transform("ancestors", unpack_uuid).alias("ancestors")] if ancestors else []),
        F.coalesce("n_descendants", F.lit(0)).cast("bigint").alias("n_descendants"),
    )
