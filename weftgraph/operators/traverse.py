"""Graph traversal as joins: hops, bounded expansion, hierarchies, exploration, reference linking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.strings import similar_between


def oriented(edges: DataFrame, direction: str, *keep: str) -> DataFrame:
    """``a, b`` along the direction; ``both`` gives each edge twice, a loop once."""
    if direction == "outgoing":
        return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *keep)
    if direction == "incoming":
        return edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), *keep)
    if direction != "both":
        raise ValueError(f"unknown direction: {direction}")
    return oriented(edges, "outgoing", *keep).unionByName(oriented(edges, "incoming", *keep).where(F.col("a") != F.col("b")))


def one_hop(rows: DataFrame, key: str, edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    """Rows joined with their neighbours as ``_next``: one row per edge, nothing is made distinct."""
    e = oriented(edges, direction)
    return rows.join(e, rows[key] == e["a"]).drop("a").withColumnRenamed("b", "_next")


def related_to(rows: DataFrame, key: str, edges: DataFrame, anchors: DataFrame, direction: str = "outgoing") -> DataFrame:
    """Rows with an edge to one of ``anchors(id)``, each once: a semi-join."""
    e = oriented(edges, direction).join(anchors.select(F.col("id").alias("_id")), F.col("b") == F.col("_id"), "left_semi")
    return rows.join(e, rows[key] == e["a"], "left_semi")


def expand(roots: DataFrame, edges: DataFrame, depth: int = 1, direction: str = "outgoing") -> DataFrame:
    """``root, node, depth``: every path of 1 to ``depth`` edges from ``roots(id)``, one row per path.

    No edge is used twice within a path, nodes may be. ``edges`` needs an ``edge_id`` if the depth exceeds 1.
    """
    keep = ("edge_id",) if "edge_id" in edges.columns else ()
    if depth > 1 and not keep:
        edges, keep = edges.withColumn("edge_id", F.monotonically_increasing_id()), ("edge_id",)
    step = oriented(edges, direction, *keep)
    front = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.array().cast("array<bigint>").alias("used"))
    out = None
    for d in range(1, depth + 1):
        nxt = front.join(step, front["node"] == step["a"])
        if keep:
            nxt = nxt.where(~F.array_contains("used", F.col("edge_id").cast("bigint")))
            used = F.array_append("used", F.col("edge_id").cast("bigint"))
        else:
            used = F.col("used")
        front = nxt.select("root", F.col("b").alias("node"), used.alias("used"))
        part = front.select("root", "node", F.lit(d).alias("depth"))
        out = part if out is None else out.unionByName(part)
    return out


def with_related(rows: DataFrame, key: str, paths: DataFrame) -> DataFrame:
    """Rows with ``related``, the list of (node, depth) of their paths; empty where there is none."""
    lists = paths.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("related"))
    got = rows.join(lists, rows[key] == lists["root"], "left").drop("root")
    empty = F.array().cast(dict((f.name, f.dataType) for f in got.schema.fields)["related"])
    return got.withColumn("related", F.coalesce("related", empty))


def collect_related(rows: DataFrame, key: str, edges: DataFrame, out: str = "related") -> DataFrame:
    """Rows with the sorted distinct targets of their outgoing edges, empty where there is none."""
    lists = oriented(edges, "outgoing").groupBy("a").agg(F.array_sort(F.collect_set("b")).alias(out))
    got = rows.join(lists, rows[key] == lists["a"], "left").drop("a")
    return got.withColumn(out, F.coalesce(out, F.array().cast(dict((f.name, f.dataType) for f in got.schema.fields)[out])))


def enrich_names(rows: DataFrame, key: str, edges: DataFrame, names: DataFrame, out: str, direction: str = "outgoing") -> DataFrame:
    """Rows with the sorted distinct names of their neighbours: aggregated before the join, so relations do not multiply."""
    e = oriented(edges, direction)
    lists = e.join(names.select(F.col("id").alias("_id"), "name"), F.col("b") == F.col("_id")).groupBy("a").agg(F.array_sort(F.collect_set("name")).alias(out))
    return rows.join(lists, rows[key] == lists["a"], "left").drop("a").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def children_by_parent(parents: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """``parent, child, place`` of ``parents(id)``, children in order."""
    got = edges.join(parents.select(F.col("id").alias("_id")), F.col("src") == F.col("_id"), "left_semi").select(F.col("src").alias("parent"), F.col("dst").alias("child")).distinct()
    got = got.withColumn("place", F.row_number().over(W.partitionBy("parent").orderBy("child")))
    return got if limit is None else got.where(F.col("place") <= limit)


def reachable(roots: DataFrame, edges: DataFrame, depth: int, direction: str = "outgoing") -> DataFrame:
    """``root, node, depth``: nodes within ``depth`` edges with their least depth, by frontier: a node is expanded once."""
    # only edges of the frontier are ever made distinct, with the nodes they lead to
    step = oriented(edges, direction)
    seen = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        nxt = front.join(step, front["node"] == step["a"]).select("root", F.col("b").alias("node")).distinct()
        front = nxt.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def dependency_hierarchy(roots: DataFrame, consumes: DataFrame, inherits: DataFrame, depth: int = 2, per_branch: int | None = None) -> DataFrame:
    """``root, node, depth, relation``: what roots consume and who consumes them, parents and heirs; distinct rows.

    All roots go through one traversal. ``per_branch`` keeps the nearest nodes of each branch (ties by node).
    """
    out = None
    for name, edges, direction in (
        ("CONSUMES", consumes, "outgoing"), ("CONSUMED_BY", consumes, "incoming"), ("INHERITS_FROM", inherits, "outgoing"), ("INHERITED_BY", inherits, "incoming"),
    ):
        part = reachable(roots, edges, depth, direction).where("depth > 0").withColumn("relation", F.lit(name))
        if per_branch is not None:
            w = W.partitionBy("root").orderBy("depth", "node")
            part = part.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_branch).drop("_r")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def nearest_edges(front: DataFrame, edges: DataFrame, per_direction: int) -> DataFrame:
    """``a, b, type, dir``: at most so many edges of each of ``front(node)`` and direction, by type, then neighbour.

    Edges are first reduced to those of the frontier; the limit of a hub is applied before the shuffle as well.
    """
    own = front.select(F.col("node").alias("_f")).distinct()
    part = lambda direction, name: oriented(edges, direction, "type").join(own, F.col("a") == F.col("_f"), "left_semi").withColumn("dir", F.lit(name))
    both = part("outgoing", "out").unionByName(part("incoming", "in")).distinct()
    w = W.partitionBy("a", "dir").orderBy("type", "b")
    return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_direction).drop("_r")


def explore(hits: DataFrame, edges: DataFrame, depth: int = 1, max_roots: int = 10, per_direction: int = 15) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around the best ``hits(id, score)``: breadth-first, depth 1 to 3, at most ``per_direction`` edges of
    each node and direction (by type, then neighbour). Nodes come once, hits first; edges once by source, target, type.

    ``edges`` has ``src, dst, type``. Result nodes: ``node, depth, is_hit, score``; edges: ``src, dst, type``.
    """
    depth = min(max(depth, 1), 3)
    roots = hits.orderBy(F.col("score").desc(), "id").limit(max_roots)
    seen = roots.select(F.col("id").alias("node"), F.lit(0).alias("depth"))
    front, used = seen, None
    for d in range(1, depth + 1):
        step = nearest_edges(front.select("node"), edges, per_direction)
        found = step.select(
            F.when(F.col("dir") == "out", F.col("a")).otherwise(F.col("b")).alias("src"),
            F.when(F.col("dir") == "out", F.col("b")).otherwise(F.col("a")).alias("dst"), "type",
        )
        used = found if used is None else used.unionByName(found)
        front = step.select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    scores = hits.groupBy(F.col("id").alias("node")).agg(F.max("score").alias("score"))
    nodes = seen.join(scores, "node", "left").withColumn("is_hit", F.col("score").isNotNull())
    return nodes, used.distinct()


def neighbours_by_relation(node_id: str | int, edges: DataFrame, depth: int = 1, limit: int = 20) -> DataFrame:
    """``key, node, depth``: the neighbourhood of one node grouped by ``TYPE`` or ``TYPE_BY``; half the limit below depth 1."""
    front = edges.sparkSession.createDataFrame([(node_id,)], edges.select("src").toDF("node").schema)
    out = None
    for d in range(1, min(max(depth, 1), 3) + 1):
        n = limit if d == 1 else limit // 2
        own = front.select(F.col("node").alias("_f"))
        sides = [oriented(edges, way, "type").join(own, F.col("a") == F.col("_f"), "left_semi").withColumn("key", key) for way, key in (("outgoing", F.col("type")), ("incoming", F.concat("type", F.lit("_BY"))))]
        step = sides[0].unionByName(sides[1]).distinct()
        step = step.withColumn("_r", F.row_number().over(W.partitionBy("a", "key").orderBy("b"))).where(F.col("_r") <= n)
        part = step.select("key", F.col("b").alias("node"), F.lit(d).alias("depth")).distinct()
        out = part if out is None else out.unionByName(part)
        front = part.select("node").distinct()
    return out.groupBy("key", "node").agg(F.min("depth").alias("depth"))


def path_ancestors(path: Column) -> Column:
    """All directories above an absolute path, nearest last: a walk to the root without a join."""
    parts = F.filter(F.split(path, "/", -1), lambda x: x != "")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))


def resolve_pending(pending: DataFrame, files: DataFrame) -> DataFrame:
    """``src, target, type`` with ``dst``: pending references whose target equals a file's ``file`` or its ``path``.

    An equi-join with either spelling instead of a condition with OR, which could only run as a nested loop; the smallest id wins.
    """
    # one row per target before the join, so a name that many files share multiplies nothing
    both = files.select("id", F.explode(F.array("file", "path")).alias("target")).where("target is not null")
    return pending.select("src", "target", "type").distinct().join(both.groupBy("target").agg(F.min("id").alias("dst")), "target").select("src", "target", "type", "dst")


def fuzzy_file_match(refs: DataFrame, files: DataFrame, minimum: float = 0.7) -> DataFrame:
    """``ref, path, tier, score``: the best file for each loose reference.

    Tiers: the path ends with the reference (1.0), its file name is unique (0.95) or not (0.7), or names of the same
    extension, then of any (times 0.9), are similar enough. Distinct names meet by equal segments (``strings``).
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    ext = lambda c: F.regexp_extract(c, r"\.(\w+)$", 1)
    r = refs.select("ref").distinct().withColumn("rname", F.lower(name(F.col("ref"))))
    f = files.select("path").distinct().withColumn("fname", F.lower(name(F.col("path"))))
    many = f.groupBy("fname").agg(F.count(F.lit(1)).alias("n"))
    exact = r.join(f, r.rname == f.fname).join(many, "fname")
    suffix = (F.col("path") == F.col("ref")) | F.endswith(F.col("path"), F.concat(F.lit("/"), F.col("ref")))
    tiered = exact.select(
        "ref", "path", F.when(suffix, 1).when(F.col("n") == 1, 2).otherwise(3).alias("tier"),
        F.when(suffix, 1.0).when(F.col("n") == 1, 0.95).otherwise(0.7).alias("score"),
    )
    left = r.join(exact.select("ref").distinct(), "ref", "left_anti")
    names = f.select("fname").distinct()
    near = similar_between(left.select("rname").distinct(), names, minimum, left_id="rname", left_text="rname", right_id="fname", right_text="fname")
    near = near.select(F.col("l").alias("rname"), F.col("r").alias("fname"), F.col("similarity").alias("sim"))
    same = ext(F.col("rname")) == ext(F.col("fname"))
    fuzzy = left.join(near, "rname").join(f, "fname").select(
        "ref", "path", F.when(same, 4).otherwise(5).alias("tier"), F.when(same, F.col("sim")).otherwise(F.col("sim") * 0.9).alias("score")
    )
    best = F.row_number().over(W.partitionBy("ref").orderBy("tier", F.col("score").desc(), F.length("path"), "path"))
    return tiered.unionByName(fuzzy).where(F.col("score") >= minimum).withColumn("_r", best).where("_r = 1").drop("_r")


def resolve_imports(imports: DataFrame, files: DataFrame, extensions: Sequence[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """``src, spec, path``: the first existing file among the spellings that an import may mean, by their order."""
    target = F.col("base")
    for k, v in (aliases or {}).items():
        target = F.when(F.startswith(target, F.lit(k)), F.concat(F.lit(v), F.substring(target, len(k) + 1, 1 << 30))).otherwise(target)
    spellings = F.array(target, *(F.concat(target, F.lit(e)) for e in extensions), *(F.concat(target, F.lit("/index"), F.lit(e)) for e in extensions))
    cand = imports.select("src", "spec", F.posexplode(spellings).alias("place", "path"))
    hit = cand.join(files.select("path").distinct(), "path")
    return hit.groupBy("src", "spec").agg(F.min_by("path", "place").alias("path"))


def preserve_ids(captured: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows that take over the id of the captured row with the same symbol: ``file:name``, else ``file:_:line``."""
    symbol = F.concat_ws(":", "file", F.when(F.length("name") > 0, F.col("name")).otherwise(F.concat(F.lit("_:"), F.col("start_line").cast("string"))))
    old = captured.withColumn("_s", symbol).groupBy("_s").agg(F.min("uuid").alias("_old"))
    return fresh.withColumn("_s", symbol).join(old, "_s", "left").withColumn("uuid", F.coalesce("_old", "uuid")).drop("_s", "_old")
