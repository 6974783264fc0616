"""Joins, traversal, ETL over the node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators import etl as E
from weftgraph.operators import traverse as T
from weftgraph.operators.orphans import EXTENSIONS, resolve_path
from weftgraph.operators.segments import previous
from weftgraph.queries.registry import Registry, Tables
from weftgraph.queries.relational import _CH, event_changes, shop
from weftgraph.tools import list_projects

R = Registry()
QUERIES, SQL = R.queries, R.sql


def node_edges(t: Tables) -> DataFrame:
    """Parent to child, each once."""
    return t.nodes.where("parent_uuid <> ''").select(F.upper("parent_uuid").alias("src"), F.col("uuid").alias("dst")).distinct()


_NE = "WITH RECURSIVE e AS (SELECT DISTINCT upper(parent_uuid) AS src, uuid AS dst FROM nodes WHERE parent_uuid <> '')"


def follows(t: Tables) -> DataFrame:
    """From each event's user to the user of the next event of that day, if another: once per pair and type."""
    e = t.events.select(F.to_date("ts").alias("day"), "ts", "event_id", F.struct("user_id", "event_type").alias("own"))
    e = previous(e, ["day"], ["ts", "event_id"], "own", "before").select(F.col("before.user_id").alias("src"), F.col("own.user_id").alias("dst"), F.col("before.event_type").alias("type"))
    return e.where("src is not null and src <> dst").distinct()


_FO = """WITH RECURSIVE f AS (SELECT DISTINCT src, dst, type FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst, event_type AS type FROM events)
 WHERE dst IS NOT NULL AND src <> dst)"""


@R.add("traverse_two_hop", """SELECT c.c_custkey, r.r_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey""")
def _(t: Tables) -> DataFrame:
    c = shop(t)
    a = T.one_hop(t.customer, "c_custkey", c.relationships["IN_NATION"].edges).withColumnRenamed("_next", "nation")
    b = T.one_hop(a, "nation", c.relationships["IN_REGION"].edges)
    return b.join(t.region, F.col("_next") == F.col("r_regionkey")).select("c_custkey", "r_name")


@R.add("traverse_both", _FO + " SELECT DISTINCT src AS a, dst AS b FROM f UNION ALL SELECT DISTINCT dst, src FROM f WHERE src <> dst")
def _(t: Tables) -> DataFrame:
    return T.oriented(follows(t).select("src", "dst").distinct(), "both")


@R.add("related_by_semi", """SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1)""")
def _(t: Tables) -> DataFrame:
    anchors = t.part.where("p_size = 1").select(F.col("p_partkey").alias("id"))
    return T.related_to(t.supplier, "s_suppkey", shop(t).relationships["SUPPLIED_BY"].edges, anchors, "incoming").select("s_suppkey", "s_name")


@R.add("enrich_collect_names", """SELECT r_regionkey, list_sort(list(n_name)) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    names = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return T.enrich_names(t.region, "r_regionkey", shop(t).relationships["IN_REGION"].edges, names, "nations", "incoming").select("r_regionkey", "nations")


@R.add("left_join_counts", "SELECT p.project_id, p.project_name, count(n.uuid) AS n_nodes FROM projects p LEFT JOIN nodes n ON n.project_id = p.project_id GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return list_projects(t.projects, t.nodes).select("project_id", "project_name", "n_nodes")


@R.add("orphan_anti_join", "SELECT DISTINCT file_uuid FROM extracted_refs r WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.uuid = upper(r.file_uuid)) AND file_uuid IS NOT NULL")
def _(t: Tables) -> DataFrame:
    refs = t.extracted_refs.where("file_uuid is not null").select(F.upper("file_uuid").alias("k"), "file_uuid")
    return E.orphans(refs, "k", t.nodes, "uuid").select("file_uuid").distinct()


@R.add("children_by_parent", _NE + " SELECT src AS parent, dst AS child, row_number() OVER (PARTITION BY src ORDER BY dst) AS place FROM e")
def _(t: Tables) -> DataFrame:
    e = node_edges(t)
    return T.children_by_parent(e.select(F.col("src").alias("id")).distinct(), e)


@R.add("expand_depth2", _NE + """ SELECT root, depth, count(*) AS n_paths FROM (
 SELECT src AS root, 1 AS depth, dst FROM e UNION ALL SELECT a.src, 2, b.dst FROM e a JOIN e b ON b.src = a.dst AND NOT (a.src = b.src AND a.dst = b.dst)) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    e = node_edges(t).withColumn("edge_id", F.xxhash64("src", "dst"))
    paths = T.expand(e.select(F.col("src").alias("id")).distinct(), e, 2)
    return paths.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n_paths"))


@R.add("reachable_depth3", _NE + """, r(root, node, depth) AS (SELECT DISTINCT src, src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e)
 UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3) SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    e = node_edges(t)
    tops = e.select(F.col("src").alias("id")).join(e.select(F.col("dst").alias("id")), "id", "left_anti").distinct()
    return T.reachable(tops, e, 3)


_HU = """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, l_suppkey AS dst FROM part JOIN lineitem ON l_partkey = p_partkey),
 i AS (SELECT c_custkey AS src, CAST(c_nationkey AS BIGINT) AS dst FROM customer),
 s AS (SELECT 'CONSUMES' AS relation, src AS a, dst AS b FROM e UNION ALL SELECT 'CONSUMED_BY', dst, src FROM e UNION ALL SELECT 'INHERITS_FROM', src, dst FROM i UNION ALL SELECT 'INHERITED_BY', dst, src FROM i),
 w(relation, root, node, depth) AS (SELECT DISTINCT relation, CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 0 FROM nation, (SELECT DISTINCT relation FROM s)
  UNION SELECT w.relation, w.root, s.b, w.depth + 1 FROM w JOIN s ON s.relation = w.relation AND s.a = w.node WHERE w.depth < {depth})
 SELECT root, node, min(depth) AS depth, relation FROM w GROUP BY relation, root, node HAVING min(depth) > 0"""


@R.add("hierarchy_union", _HU.format(depth=2))
def _(t: Tables) -> DataFrame:
    c = shop(t)
    roots = t.nation.select(F.col("n_nationkey").cast("long").alias("id"))
    return T.dependency_hierarchy(roots, c.relationships["SUPPLIED_BY"].edges, c.relationships["IN_NATION"].edges, 2)


@R.add("bfs_explore_nodes", _FO + """, hits AS (SELECT user_id AS id, sum(value) AS score FROM events GROUP BY 1),
 roots AS (SELECT id FROM hits ORDER BY score DESC, id LIMIT 10),
 b AS (SELECT a, b, type, dir FROM (SELECT *, row_number() OVER (PARTITION BY a, dir ORDER BY type, b) AS rn FROM (
   SELECT src AS a, dst AS b, type, 'out' AS dir FROM f UNION ALL SELECT dst, src, type, 'in' FROM f)) WHERE rn <= 15),
 l1 AS (SELECT DISTINCT b AS node FROM roots JOIN b ON b.a = roots.id WHERE b NOT IN (SELECT id FROM roots)),
 l2 AS (SELECT DISTINCT b AS node FROM l1 JOIN b ON b.a = l1.node WHERE b NOT IN (SELECT id FROM roots) AND b NOT IN (SELECT node FROM l1))
 SELECT id AS node, 0 AS depth FROM roots UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2""")
def _(t: Tables) -> DataFrame:
    hits = t.events.groupBy(F.col("user_id").alias("id")).agg(F.sum("value").alias("score"))
    return T.explore(hits, follows(t), depth=2)[0].select("node", "depth")


_BFS = _FO + """, hits AS (SELECT user_id AS id, sum(value) AS score FROM events GROUP BY 1),
 roots AS (SELECT id FROM hits ORDER BY score DESC, id LIMIT 10),
 b AS (SELECT a, b, type, dir FROM (SELECT *, row_number() OVER (PARTITION BY a, dir ORDER BY type, b) AS rn FROM (
   SELECT src AS a, dst AS b, type, 'out' AS dir FROM f UNION ALL SELECT dst, src, type, 'in' FROM f)) WHERE rn <= 15),
 l1 AS (SELECT DISTINCT b AS node FROM roots JOIN b ON b.a = roots.id WHERE b NOT IN (SELECT id FROM roots))"""


@R.add("bfs_explore_edges", _BFS + """ SELECT DISTINCT CASE WHEN dir = 'out' THEN a ELSE b END AS src, CASE WHEN dir = 'out' THEN b ELSE a END AS dst, type
 FROM (SELECT id FROM roots UNION SELECT node FROM l1) x JOIN b ON b.a = x.id""")
def _(t: Tables) -> DataFrame:
    hits = t.events.groupBy(F.col("user_id").alias("id")).agg(F.sum("value").alias("score"))
    return T.explore(hits, follows(t), depth=2)[1]


@R.add("explore_one_node", _FO + """, s AS (SELECT src AS a, dst AS b, type AS key FROM f UNION SELECT dst, src, type || '_BY' FROM f),
 l1 AS (SELECT key, b FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY b) AS rn FROM s WHERE a = (SELECT min(user_id) FROM events)) WHERE rn <= 20),
 l2 AS (SELECT DISTINCT key, b FROM (SELECT s.*, row_number() OVER (PARTITION BY s.a, s.key ORDER BY s.b) AS rn FROM s WHERE a IN (SELECT b FROM l1)) WHERE rn <= 10)
 SELECT key, node, min(depth) AS depth FROM (SELECT key, b AS node, 1 AS depth FROM l1 UNION ALL SELECT key, b, 2 FROM l2) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    first = t.events.agg(F.min("user_id")).head()[0]
    return T.neighbours_by_relation(first, follows(t), 2, 20)


@R.add("ancestor_paths", r"""SELECT DISTINCT source_path, d.path AS ancestor FROM (SELECT DISTINCT source_path FROM source_files) s,
 LATERAL (SELECT '/' || array_to_string(list_slice(list_filter(string_split(source_path, '/'), lambda x: x <> ''), 1, i), '/') AS path
   FROM unnest(range(1, len(list_filter(string_split(source_path, '/'), lambda x: x <> '')))) u(i)) d""")
def _(t: Tables) -> DataFrame:
    return t.source_files.select("source_path").distinct().select("source_path", F.explode(T.path_ancestors(F.col("source_path"))).alias("ancestor"))


@R.add("directories_materialised", r"""WITH p AS (SELECT DISTINCT '/' || array_to_string(list_slice(list_filter(string_split(source_path, '/'), lambda x: x <> ''), 1, i), '/') AS path
 FROM (SELECT DISTINCT source_path FROM source_files), LATERAL (SELECT unnest(range(1, len(list_filter(string_split(source_path, '/'), lambda x: x <> '')))) AS i))
 SELECT path, nullif(regexp_replace(path, '/[^/]*$', ''), '') AS parent, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth FROM p""")
def _(t: Tables) -> DataFrame:
    return E.directories_of(t.source_files.select(F.col("source_path").alias("path")))


@R.add("project_of_path", """SELECT path, max_by(project_id, (length(root), created_at, project_id)) AS project_id FROM (SELECT DISTINCT source_path AS path FROM source_files) f
 JOIN (SELECT project_id, root_path AS root, created_at FROM projects) p ON path = root OR starts_with(path, root || '/') GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    p = t.projects.select("project_id", "root_path", F.col("created_at").alias("last_accessed"))
    return E.project_of_path(t.source_files.select(F.col("source_path").alias("path")), p, longest=True)


@R.add("project_of_path_accessed", """SELECT path, max_by(project_id, (created_at, length(root), project_id)) AS project_id FROM (SELECT DISTINCT source_path AS path FROM source_files) f
 JOIN (SELECT project_id, root_path AS root, created_at FROM projects) p ON path = root OR starts_with(path, root || '/') GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    p = t.projects.select("project_id", "root_path", F.col("created_at").alias("last_accessed"))
    return E.project_of_path(t.source_files.select(F.col("source_path").alias("path")), p)


@R.add("collect_related", "SELECT c_custkey, coalesce(list_sort(list(DISTINCT o_orderkey) FILTER (o_orderkey IS NOT NULL)), []) AS related FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    placed = t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return T.collect_related(t.customer, "c_custkey", placed).select("c_custkey", "related")


@R.add("resolve_pending_refs", """SELECT src, target, 'PENDING_IMPORT' AS type, min(id) AS dst FROM (
 SELECT DISTINCT r.ref_id AS src, r.ref_source AS target, n.id FROM extracted_refs r JOIN (
  SELECT uuid AS id, node_name AS k FROM nodes WHERE node_label LIKE '%File' UNION SELECT uuid, source_path FROM nodes WHERE node_label LIKE '%File') n ON n.k = regexp_replace(r.ref_source, '^.*/', '') OR n.k = r.ref_source) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    refs = t.extracted_refs.select(F.col("ref_id").alias("src"), F.col("ref_source").alias("full"), F.regexp_replace("ref_source", "^.*/", "").alias("target"), F.lit("PENDING_IMPORT").alias("type")).distinct()
    files = t.nodes.where("node_label like '%File'").select(F.col("uuid").alias("id"), F.col("node_name").alias("file"), F.col("source_path").alias("path")).distinct()
    named = T.resolve_pending(refs.select("src", "target", "type"), files).select("src", "dst")
    whole = T.resolve_pending(refs.select("src", F.col("full").alias("target"), "type"), files).select("src", "dst")
    best = named.unionByName(whole).groupBy("src").agg(F.min("dst").alias("dst"))
    return best.join(refs, "src").select("src", F.col("full").alias("target"), "type", "dst").distinct()


_SPELLINGS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(("", *EXTENSIONS, *(f"/index{e}" for e in EXTENSIONS))))


@R.add("resolve_imports", rf"""WITH r AS (SELECT DISTINCT ref_id AS src, ref_source AS spec, source_path, regexp_replace(ref_source, '[#?].*$', '', 's') AS bare
  FROM extracted_refs WHERE is_local OR regexp_matches(ref_source, '^\.\.?/')),
 b AS (SELECT src, spec, list_reduce(list_prepend('', string_split(CASE WHEN starts_with(bare, '/') THEN bare ELSE regexp_replace(source_path, '[^/]*$', '') || bare END, '/')),
   lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x IN ('', '.') THEN acc ELSE acc || '/' || x END) AS base FROM r WHERE trim(bare) <> ''),
 c AS (SELECT src, spec, o, base || x AS path FROM b, (VALUES {_SPELLINGS}) e(o, x))
 SELECT src, spec, min_by(path, o) AS path FROM c WHERE path IN (SELECT source_path FROM source_files) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    i = t.extracted_refs.where(F.col("is_local") | F.col("ref_source").rlike(r"^\.\.?/")).select(
        F.col("ref_id").alias("src"), F.col("ref_source").alias("spec"), resolve_path(F.col("source_path"), F.col("ref_source")).alias("base")).where("base is not null").distinct()
    return T.resolve_imports(i, t.source_files.select(F.col("source_path").alias("path")), EXTENSIONS)


@R.add("preserve_ids", """SELECT n.uuid AS fresh, coalesce(o.old, n.uuid) AS uuid FROM (SELECT uuid, source_path || ':' || CASE WHEN length(node_name) > 0 THEN node_name ELSE '_:' || start_line END AS s FROM nodes WHERE node_label = 'Scope') n
 LEFT JOIN (SELECT source_path || ':' || CASE WHEN length(node_name) > 0 THEN node_name ELSE '_:' || start_line END AS s, min(uuid) AS old FROM nodes WHERE node_label = 'Scope' AND content_version = 1 GROUP BY 1) o ON o.s = n.s""")
def _(t: Tables) -> DataFrame:
    cols = lambda d: d.where("node_label = 'Scope'").select("uuid", F.col("uuid").alias("fresh"), F.col("source_path").alias("file"), F.col("node_name").alias("name"), "start_line")
    return T.preserve_ids(cols(t.nodes.where("content_version = 1")), cols(t.nodes)).select("fresh", "uuid")


# change sets and state


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each node's first and latest version."""
    n = t.nodes.where("uuid is not null")
    old = n.groupBy("uuid").agg(F.min_by("content_hash", F.struct("updated_at", "recorded_at")).alias("content_hash"), F.min("created_at").alias("at"))
    new = n.groupBy("uuid").agg(F.max_by(F.struct("content_hash", "deleted_at", "node_state"), F.struct("updated_at", "recorded_at")).alias("c"))
    return old.where("at < '2025-09-01'").drop("at"), new.select("uuid", "c.*").where("deleted_at is null")


_SN = """WITH old AS (SELECT * FROM (SELECT uuid, min_by(content_hash, (updated_at, recorded_at)) AS content_hash, min(created_at) AS a FROM nodes GROUP BY 1) WHERE a < TIMESTAMP '2025-09-01'),
 new AS (SELECT uuid, c.content_hash, c.node_state FROM (SELECT uuid, max_by({'content_hash': content_hash, 'deleted_at': deleted_at, 'node_state': node_state}, (updated_at, recorded_at)) AS c FROM nodes GROUP BY 1) WHERE c.deleted_at IS NULL)"""


@R.add("diff_classify", _SN + """ SELECT coalesce(n.uuid, o.uuid) AS uuid, CASE WHEN o.uuid IS NULL THEN 'created' WHEN n.uuid IS NULL THEN 'deleted'
 WHEN o.content_hash IS NOT DISTINCT FROM n.content_hash THEN 'unchanged' ELSE 'updated' END AS change FROM old o FULL JOIN new n ON n.uuid = o.uuid""")
def _(t: Tables) -> DataFrame:
    return E.classify_changes(*snapshots(t), "uuid", "content_hash")


@R.add("upsert_merge_patch", _SN + """ SELECT coalesce(o.uuid, n.uuid) AS uuid, coalesce(n.content_hash, o.content_hash) AS content_hash FROM old o FULL JOIN new n ON n.uuid = o.uuid""")
def _(t: Tables) -> DataFrame:
    old, new = snapshots(t)
    return E.merge_patch(old, new.select("uuid", "content_hash"), "uuid", insert=True)


@R.add("update_unknown_keys", _SN + " SELECT uuid FROM new WHERE uuid NOT IN (SELECT uuid FROM old)")
def _(t: Tables) -> DataFrame:
    return E.unknown_keys(*snapshots(t), "uuid")


@R.add("delete_detach", _NE + """, g AS (SELECT DISTINCT uuid FROM nodes WHERE deleted_at IS NOT NULL) SELECT src, dst FROM e WHERE src NOT IN (SELECT uuid FROM g) AND dst NOT IN (SELECT uuid FROM g)""")
def _(t: Tables) -> DataFrame:
    gone = t.nodes.where("deleted_at is not null").select(F.col("uuid").alias("id"))
    return E.delete_detach(t.nodes.select(F.col("uuid").alias("id")).distinct(), node_edges(t), gone)[1]


@R.add("merge_edges", _NE + """, n AS (SELECT DISTINCT uuid FROM nodes) SELECT src, dst, 'HAS_PARENT' AS type FROM e WHERE src IN (SELECT uuid FROM n) UNION SELECT upper(file_uuid), upper(file_uuid), 'SELF' FROM extracted_refs WHERE upper(file_uuid) IN (SELECT uuid FROM n)""")
def _(t: Tables) -> DataFrame:
    nodes = t.nodes.select(F.col("uuid").alias("id")).distinct()
    tree = node_edges(t).withColumn("type", F.lit("HAS_PARENT"))
    f = F.upper("file_uuid")
    return E.merge_edges(E.merge_edges(tree.limit(0), tree, nodes), t.extracted_refs.select(f.alias("src"), f.alias("dst"), F.lit("SELF").alias("type")), nodes)


@R.add("gc_orphans", """SELECT uuid, recorded_at FROM nodes WHERE project_id IN (SELECT project_id FROM projects WHERE NOT coalesce(is_excluded, false))""")
def _(t: Tables) -> DataFrame:
    kept, _ = E.collect_garbage(t.nodes, t.projects.where("not coalesce(is_excluded, false)"), node_edges(t), "uuid")
    return kept.select("uuid", "recorded_at")


@R.add("stale_mentions", """SELECT src, dst FROM (SELECT DISTINCT source_path AS src, s AS dst FROM (SELECT source_path, unnest(symbols) AS s FROM extracted_refs WHERE recorded_at < TIMESTAMP '2025-07-01'))
 EXCEPT SELECT source_path, s FROM (SELECT source_path, unnest(symbols) AS s FROM extracted_refs WHERE recorded_at >= TIMESTAMP '2025-07-01')""")
def _(t: Tables) -> DataFrame:
    m = t.extracted_refs.select("recorded_at", F.col("source_path").alias("src"), F.explode("symbols").alias("dst"))
    return E.stale_mentions(m.where("recorded_at < '2025-07-01'"), m.where("recorded_at >= '2025-07-01'"), m.select(F.col("dst").alias("id")).distinct())[0]


_TR = ", ".join(f"('{a}', '{b}')" for a, bs in E.TRANSITIONS.items() for b in bs)


@R.add("state_transition_invalid", f"""WITH s AS (SELECT uuid, updated_at, node_state AS from_state, lead(node_state) OVER (PARTITION BY uuid ORDER BY updated_at) AS to_state
  FROM (SELECT DISTINCT uuid, updated_at, node_state FROM nodes)), tr(a, b) AS (VALUES {_TR})
 SELECT uuid, from_state, to_state FROM s WHERE to_state IS NOT NULL AND from_state <> to_state AND NOT EXISTS (SELECT 1 FROM tr WHERE a = from_state AND b = to_state)""")
def _(t: Tables) -> DataFrame:
    w = W.partitionBy("uuid").orderBy("updated_at")
    s = t.nodes.select("uuid", "updated_at", "node_state").distinct().select("uuid", F.col("node_state").alias("from_state"), F.lead("node_state").over(w).alias("to_state"))
    return E.invalid_transitions(s.where("to_state is not null and from_state <> to_state"))


@R.add("retryable_errors", "SELECT uuid, updated_at, recorded_at FROM nodes WHERE node_state = 'error' AND coalesce(retry_count, 0) < 3")
def _(t: Tables) -> DataFrame:
    return E.retryable(t.nodes).select("uuid", "updated_at", "recorded_at")


@R.add("stuck_rows", """SELECT uuid, recorded_at FROM nodes WHERE node_state IN ('parsing', 'linking', 'entities', 'embedding') AND updated_at < TIMESTAMP '2025-12-01' - INTERVAL 5 MINUTES""")
def _(t: Tables) -> DataFrame:
    return E.stuck(t.nodes, F.lit("2025-12-01").cast("timestamp")).select("uuid", "recorded_at")


@R.add("crash_recovery", """SELECT node_state, count(*) AS n FROM (SELECT CASE WHEN node_state IN ('parsing', 'linking', 'entities', 'embedding') OR (node_state = 'error' AND coalesce(retry_count, 0) < 3) THEN 'pending' ELSE node_state END AS node_state FROM nodes) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return E.recover(t.nodes).groupBy("node_state").agg(F.count(F.lit(1)).alias("n"))


@R.add("entity_history", _CH + " SELECT change_id, change_type, ts FROM changes WHERE entity_id = (SELECT min(user_id) FROM events) ORDER BY ts DESC, change_id DESC LIMIT 10")
def _(t: Tables) -> DataFrame:
    first = t.events.agg(F.min("user_id")).head()[0]
    return E.entity_history(event_changes(t), F.lit(first)).select("change_id", "change_type", "ts")


@R.add("recent_changes", _CH + " SELECT change_id, entity_id, ts FROM changes WHERE entity_type IN ('Mon', 'Tue') ORDER BY ts DESC, change_id DESC LIMIT 20")
def _(t: Tables) -> DataFrame:
    return E.recent_changes(event_changes(t), ["Mon", "Tue"]).select("change_id", "entity_id", "ts")


@R.add("changes_by_range", _CH + " SELECT change_id, ts FROM changes WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11'")
def _(t: Tables) -> DataFrame:
    return E.changes_between(event_changes(t), "2024-01-10", "2024-01-11").select("change_id", "ts")


@R.add("needs_embedding", """WITH s AS (SELECT uuid, v.h AS h, v.m AS m FROM (SELECT uuid, max_by({'h': content_hash, 'm': embedding_model}, (recorded_at, transition_id)) AS v FROM batch_transitions WHERE target_state = 'ready' AND uuid IS NOT NULL GROUP BY 1)),
 c AS (SELECT uuid, v.h AS h FROM (SELECT uuid, max_by({'h': content_hash}, (updated_at, recorded_at)) AS v FROM nodes GROUP BY 1))
 SELECT c.uuid, CASE WHEN s.uuid IS NULL THEN 'missing' WHEN s.h IS DISTINCT FROM c.h THEN 'content' WHEN s.m IS DISTINCT FROM 'bge-x' THEN 'model' END AS reason FROM c LEFT JOIN s ON s.uuid = c.uuid
 WHERE s.uuid IS NULL OR s.h IS DISTINCT FROM c.h OR s.m IS DISTINCT FROM 'bge-x'""")
def _(t: Tables) -> DataFrame:
    o = F.struct("recorded_at", "transition_id")
    s = t.batch_transitions.where("target_state = 'ready' and uuid is not null").groupBy("uuid").agg(F.max_by("content_hash", o).alias("content_hash"), F.max_by("embedding_model", o).alias("model"))
    c = t.nodes.groupBy("uuid").agg(F.max_by("content_hash", F.struct("updated_at", "recorded_at")).alias("content_hash"))
    return E.needs_embedding(c, s, "uuid", "content_hash", "bge-x")


@R.add("clear_columns", "SELECT uuid, recorded_at, CASE WHEN node_state = 'error' THEN NULL ELSE content_hash END AS content_hash FROM nodes")
def _(t: Tables) -> DataFrame:
    return E.clear_columns(t.nodes.select("uuid", "recorded_at", "content_hash", "node_state"), ["content_hash"], F.col("node_state") == "error").drop("node_state")


@R.add("link_by_tiers", """SELECT file_uuid, min({'tier': tier, 'id': uuid}).id AS id, min({'tier': tier, 'id': uuid}).tier AS tier FROM (
 SELECT f.file_uuid, n.uuid, 1 AS tier FROM source_files f JOIN nodes n ON n.uuid = upper(f.file_uuid) UNION ALL SELECT f.file_uuid, n.uuid, 2 FROM source_files f JOIN nodes n ON n.source_path = f.source_path) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = t.source_files.select("file_uuid", F.upper("file_uuid").alias("own"), "source_path")
    targets = t.nodes.select(F.col("uuid").alias("id"), "uuid", F.col("source_path").alias("path"))
    return E.link_by_tiers(rows, targets, [{"own": "uuid"}, {"source_path": "path"}], "file_uuid")
