"""Predicates, entity plans, projections and aggregates over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.ranges import containing_ranges
from weftgraph.functions.patterns import all_of, compile_filter, glob_field, glob_names, glob_path, glob_unanchored, predicate, project_scope, url_allowed
from weftgraph.model import Catalog, Entity, Relationship, missing_required, schema_fingerprint
from weftgraph.operators import aggregate as A
from weftgraph.operators.versions import current_rows
from weftgraph.functions.ids import unpack_uuid
from weftgraph.plans.pipeline import Pipeline
from weftgraph.plans.query import get
from weftgraph.queries.registry import Registry, Tables

R = Registry()
QUERIES, SQL = R.queries, R.sql


def shop(t: Tables) -> Catalog:
    """The order tables as a property graph."""
    line = t.lineitem
    return Catalog().add(
        Entity("customer", t.customer, "c_custkey", "c_name"),
        Entity("orders", t.orders, "o_orderkey", computed={"price_k": "round(o_totalprice / 1000, 3)"}),
        Entity("part", t.part, "p_partkey", "p_name"),
        Entity("supplier", t.supplier, "s_suppkey", "s_name"),
        Entity("nation", t.nation, "n_nationkey", "n_name"),
        Entity("region", t.region, "r_regionkey", "r_name"),
        Relationship("PLACED", t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), "customer", "orders"),
        Relationship("CONTAINS", line.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")), "orders", "part"),
        Relationship("SUPPLIED_BY", line.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct(), "part", "supplier"),
        Relationship("IN_NATION", t.customer.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst")), "customer", "nation"),
        Relationship("IN_REGION", t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")), "nation", "region"),
    )


@R.add("plan_filter_traverse_topk", """SELECT o.*, round(o_totalprice / 1000, 3) AS price_k FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o_totalprice > 250000
ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def _(t: Tables) -> DataFrame:
    return get(shop(t), "orders").where("o_totalprice", ">", 250000.0).related("PLACED", "incoming").order_by("o_totalprice", False).order_by("o_orderkey").limit(25).compile()


@R.add("plan_return_target", """SELECT c.* FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F' AND o_totalprice < 20000""")
def _(t: Tables) -> DataFrame:
    return get(shop(t), "orders").where("o_orderstatus", "=", "F").where("o_totalprice", "<", 20000.0).related("PLACED", "incoming").return_target().compile()


@R.add("plan_offset_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 20 OFFSET 40")
def _(t: Tables) -> DataFrame:
    return get(shop(t), "customer").order_by("c_acctbal", False).order_by("c_custkey").offset(40).limit(20).compile().select("c_custkey", "c_name")


@R.add("filter_ops_all", """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' AND o_totalprice > 1000 AND o_totalprice >= 5000
AND o_totalprice < 400000 AND o_totalprice <= 300000 AND contains(o_orderpriority, '-') AND starts_with(o_orderpriority, '4') AND suffix(o_orderpriority, 'SPECIFIED')
OR (o_orderstatus = 'O' AND false)""")
def _(t: Tables) -> DataFrame:
    conds = [("o_orderstatus", "=", "O"), ("o_orderpriority", "!=", "1-URGENT"), ("o_totalprice", ">", 1000), ("o_totalprice", ">=", 5000), ("o_totalprice", "<", 400000),
             ("o_totalprice", "<=", 300000), ("o_orderpriority", "CONTAINS", "-"), ("o_orderpriority", "STARTS WITH", "4"), ("o_orderpriority", "ENDS WITH", "SPECIFIED")]
    return t.orders.where(all_of([predicate(*c) for c in conds])).select("o_orderkey")


@R.add("filter_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(t: Tables) -> DataFrame:
    return Pipeline(shop(t), "customer", take=None).where_in("c_mktsegment", ["BUILDING", "MACHINERY"]).execute().select("c_custkey", "c_mktsegment")


@R.add("filter_not_in", "SELECT uuid, node_label FROM nodes WHERE node_label NOT IN ('Scope', 'Directory')")
def _(t: Tables) -> DataFrame:
    return t.nodes.where(compile_filter({"node_label": {"notIn": ["Scope", "Directory"]}})).select("uuid", "node_label")


@R.add("filter_object", "SELECT event_id FROM events WHERE event_type = 'purchase' AND value >= 10 AND value < 80")
def _(t: Tables) -> DataFrame:
    return t.events.where(compile_filter({"event_type": "purchase", "value": {"gte": 10, "lt": 80}, "user_id": None})).select("event_id")


@R.add("filter_regex_fullmatch", r"SELECT p_partkey, p_type FROM part WHERE regexp_full_match(p_type, '[A-Z]+ .*')")
def _(t: Tables) -> DataFrame:
    return Pipeline(shop(t), "part", take=None).where_pattern("p_type", "[A-Z]+ .*").execute().select("p_partkey", "p_type")


@R.add("filter_glob_string", r"SELECT uuid, node_name FROM nodes WHERE regexp_full_match(node_name, '[a-m].*(Cache|Map)', 's')")
def _(t: Tables) -> DataFrame:
    g = F.col("node_name").rlike(glob_names("[a-m]*Cache")) | F.col("node_name").rlike(glob_names("[a-m]*Map"))
    return t.nodes.where(g).select("uuid", "node_name")


@R.add("filter_glob_path", r"SELECT source_path FROM source_files WHERE regexp_full_match(source_path, '(?:[^/]+/|/)*src/[^/]*\.ts')")
def _(t: Tables) -> DataFrame:
    return t.source_files.where(F.col("source_path").rlike(glob_names("/**/src/*.ts", path=True))).select("source_path")


@R.add("filter_glob_braces", r"SELECT source_path FROM source_files WHERE regexp_full_match(source_path, '.*/[^/]*\.(json|yaml)')")
def _(t: Tables) -> DataFrame:
    return t.source_files.where(F.col("source_path").rlike(glob_path("**/*.{json,yaml}"))).select("source_path")


@R.add("filter_glob_unanchored", r"SELECT source_path FROM source_files WHERE regexp_matches(source_path, 'lib/[^/]*/.*node')")
def _(t: Tables) -> DataFrame:
    return t.source_files.where(F.col("source_path").rlike(glob_unanchored("lib/*/**node"))).select("source_path")


@R.add("filter_glob_field", r"SELECT uuid, node_name FROM nodes WHERE lower(node_name) LIKE 'parse%v_'")
def _(t: Tables) -> DataFrame:
    return t.nodes.where(F.col("node_name").rlike(glob_field("PARSE*V?"))).select("uuid", "node_name")


@R.add("filter_named", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def _(t: Tables) -> DataFrame:
    c = shop(t)
    c.filters["price_between"] = lambda low, high: F.col("o_totalprice").between(low, high)
    return get(c, "orders").named_filter("price_between", low=1000, high=50000).compile().select("o_orderkey")


@R.add("filter_client", "SELECT c_custkey FROM customer WHERE length(c_name) > 12 AND c_acctbal < 0")
def _(t: Tables) -> DataFrame:
    return Pipeline(shop(t), "customer", take=None).filter(lambda d: (F.length(d.c_name) > 12) & (d.c_acctbal < 0)).execute().select("c_custkey")


@R.add("filter_date_range", "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def _(t: Tables) -> DataFrame:
    return t.events.where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))).select("event_id", "ts")


@R.add("filter_array_overlap", "SELECT ref_id, recorded_at FROM extracted_refs WHERE len(symbols) > 0 AND list_has_any(symbols, ['findNode', 'buildGraph', 'parseChunk', 'loadIndex'])")
def _(t: Tables) -> DataFrame:
    wanted = F.array(*map(F.lit, ["findNode", "buildGraph", "parseChunk", "loadIndex"]))
    return t.extracted_refs.where((F.size("symbols") > 0) & F.arrays_overlap("symbols", wanted)).select("ref_id", "recorded_at")


@R.add("filter_exists", """SELECT p.project_id FROM projects p WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.project_id = p.project_id AND n.node_state = 'error')""")
def _(t: Tables) -> DataFrame:
    return t.projects.join(t.nodes.where("node_state = 'error'").select("project_id"), "project_id", "left_semi").select("project_id")


@R.add("filter_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def _(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@R.add("filter_project_scope", """SELECT uuid, project_id FROM nodes WHERE project_id NOT IN (SELECT project_id FROM projects WHERE is_excluded)
AND lower(node_label) IN ('file', 'datafile')""")
def _(t: Tables) -> DataFrame:
    # the list of projects is an argument of the search, 40 rows whatever the data
    out = [r[0] for r in t.projects.where("is_excluded").select("project_id").collect()]
    return t.nodes.where(project_scope(F.col("project_id"), F.col("source_path"), F.col("node_label"), exclude=out, types=["File", "DataFile"])).select("uuid", "project_id")


@R.add("filter_urls", r"SELECT doc_id, url FROM documents WHERE regexp_matches(url, '\.test/') AND NOT regexp_matches(url, '/node/')")
def _(t: Tables) -> DataFrame:
    return t.documents.where(url_allowed(F.col("url"), include=[r"\.test/"], exclude=["/node/"])).select("doc_id", "url")


@R.add("filter_age", "SELECT DISTINCT run_id FROM ingest_runs WHERE started_at < TIMESTAMP '2025-12-31' - INTERVAL 30 DAYS AND run_status = 'failed'")
def _(t: Tables) -> DataFrame:
    now = F.lit("2025-12-31").cast("timestamp")
    return t.ingest_runs.where((F.col("started_at") < now - F.expr("INTERVAL 30 DAYS")) & (F.col("run_status") == "failed")).select("run_id").distinct()


@R.add("range_containment_tightest", """
SELECT ref_id, uuid FROM (
  SELECT r.ref_id, n.uuid, row_number() OVER (PARTITION BY r.ref_id ORDER BY n.end_line - n.start_line, n.uuid) AS rn
  FROM (SELECT DISTINCT ref_id, source_path, ref_line FROM extracted_refs) r
  JOIN (SELECT DISTINCT uuid, source_path, start_line, end_line FROM nodes WHERE node_label = 'Scope') n
    ON n.source_path = r.source_path AND r.ref_line BETWEEN n.start_line AND n.end_line) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    r = t.extracted_refs.select("ref_id", "source_path", "ref_line").distinct()
    n = t.nodes.where("node_label = 'Scope'").select("uuid", "source_path", "start_line", "end_line").distinct()
    j = containing_ranges(r, n, "source_path", "ref_line", "start_line", "end_line")
    return j.groupBy("ref_id").agg(F.min_by("uuid", F.struct(F.col("end_line") - F.col("start_line"), "uuid")).alias("uuid"))


@R.add("order_null_largest", "SELECT run_id, finished_at FROM ingest_runs ORDER BY finished_at DESC NULLS FIRST, run_id LIMIT 30")
def _(t: Tables) -> DataFrame:
    from weftgraph.semantics import desc

    return t.ingest_runs.orderBy(desc("finished_at"), "run_id").limit(30).select("run_id", "finished_at")


@R.add("scan_label_free", """SELECT 'customer' AS label, CAST(c_custkey AS VARCHAR) AS uuid FROM customer UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM orders
UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR) FROM region""")
def _(t: Tables) -> DataFrame:
    return shop(t).all_nodes()


@R.add("edge_counts_by_type", """SELECT 'PLACED' AS type, count(*) AS n FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem
UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) UNION ALL SELECT 'IN_NATION', count(*) FROM customer UNION ALL SELECT 'IN_REGION', count(*) FROM nation""")
def _(t: Tables) -> DataFrame:
    return shop(t).all_edges().groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@R.add("project_computed_field", "SELECT o_orderkey, round(o_totalprice / 1000, 3) AS price_k FROM orders")
def _(t: Tables) -> DataFrame:
    return shop(t).entity("orders").with_computed().select("o_orderkey", "price_k")


@R.add("project_coalesce_chain", "SELECT uuid, recorded_at, coalesce(node_name, source_path, uuid) AS title FROM nodes")
def _(t: Tables) -> DataFrame:
    return t.nodes.select("uuid", "recorded_at", F.coalesce("node_name", "source_path", "uuid").alias("title"))


@R.add("project_snippet", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM documents")
def _(t: Tables) -> DataFrame:
    from weftgraph.functions.text import truncate

    return t.documents.select("doc_id", truncate(F.col("text"), 200).alias("snippet"))


@R.add("project_case_priority", """SELECT uuid, recorded_at, CASE node_state WHEN 'error' THEN 0 WHEN 'pending' THEN 1 WHEN 'ready' THEN 3 ELSE 2 END AS priority FROM nodes""")
def _(t: Tables) -> DataFrame:
    s = F.col("node_state")
    return t.nodes.select("uuid", "recorded_at", F.when(s == "error", 0).when(s == "pending", 1).when(s == "ready", 3).otherwise(2).alias("priority"))


@R.add("schema_missing_required", """SELECT uuid, recorded_at, list_filter([CASE WHEN node_name IS NULL THEN 'node_name' END, CASE WHEN source_path IS NULL THEN 'source_path' END,
CASE WHEN content_hash IS NULL THEN 'content_hash' END], lambda x: x IS NOT NULL) AS missing FROM nodes WHERE node_name IS NULL OR source_path IS NULL OR content_hash IS NULL""")
def _(t: Tables) -> DataFrame:
    return missing_required(t.nodes, ["node_name", "source_path", "content_hash"]).select("uuid", "recorded_at", "missing")


@R.add("schema_fingerprint", """SELECT node_label, left(sha256(node_label || ':' || 'content_hash,node_name,source_path'), 12) AS fingerprint FROM (SELECT DISTINCT node_label FROM nodes WHERE node_label IS NOT NULL)""")
def _(t: Tables) -> DataFrame:
    req = F.array(F.lit("source_path"), F.lit("node_name"), F.lit("content_hash"))
    return t.nodes.where("node_label is not null").select("node_label").distinct().withColumn("fingerprint", schema_fingerprint(F.col("node_label"), req))


@R.add("current_versions", """SELECT uuid, content_hash, node_state, deleted_at FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY updated_at DESC, recorded_at) rn FROM nodes) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    return current_rows(t.nodes, [F.col("content_hash"), F.col("node_state"), F.col("deleted_at")]).select(unpack_uuid(F.col("id")).alias("uuid"), "content_hash", "node_state", "deleted_at")


# aggregates


@R.add("agg_count", "SELECT count(*) AS result FROM orders WHERE o_orderstatus = 'F'")
def _(t: Tables) -> DataFrame:
    return A.aggregate_entities(t.orders, "COUNT", conditions=[("o_orderstatus", "=", "F")])


@R.add("agg_avg_by_group", 'SELECT c_mktsegment AS "group", round(avg(c_acctbal), 6) AS result FROM customer GROUP BY 1')
def _(t: Tables) -> DataFrame:
    return A.aggregate_entities(t.customer, "AVG", "c_acctbal", group_by="c_mktsegment").withColumn("result", F.round("result", 6))


@R.add("agg_sum_by_group", 'SELECT l_returnflag AS "group", round(sum(l_quantity), 4) AS result FROM lineitem GROUP BY 1')
def _(t: Tables) -> DataFrame:
    return A.aggregate_entities(t.lineitem, "SUM", "l_quantity", group_by="l_returnflag").withColumn("result", F.round("result", 4))


@R.add("agg_min_by_group", 'SELECT p_brand AS "group", min(p_retailprice) AS result FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100')
def _(t: Tables) -> DataFrame:
    return A.aggregate_entities(t.part, "MIN", "p_retailprice", group_by="p_brand")


@R.add("agg_max", "SELECT max(o_totalprice) AS result FROM orders WHERE o_orderpriority LIKE '1%'")
def _(t: Tables) -> DataFrame:
    return A.aggregate_entities(t.orders, "MAX", "o_totalprice", [("o_orderpriority", "STARTS WITH", "1")])


@R.add("agg_count_distinct", "SELECT node_label, count(DISTINCT project_id) AS n_projects, count(DISTINCT source_path) AS n_paths FROM nodes GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.nodes.groupBy("node_label").agg(F.count_distinct("project_id").alias("n_projects"), F.count_distinct("source_path").alias("n_paths"))


@R.add("agg_collect", "SELECT project_id, list_sort(list(DISTINCT node_label)) AS labels FROM nodes GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.nodes.groupBy("project_id").agg(F.array_sort(F.collect_set("node_label")).alias("labels"))


@R.add("agg_bundle", 'SELECT count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, round(sum(value), 3) AS sum FROM events')
def _(t: Tables) -> DataFrame:
    return A.bundle(t.events, "value").withColumn("avg", F.round("avg", 6)).withColumn("sum", F.round("sum", 3))


def event_changes(t: Tables) -> DataFrame:
    """Events as a change log."""
    return t.events.select(
        F.col("event_id").alias("change_id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("change_type"), F.date_format("ts", "EEE").alias("entity_type"), "ts",
        F.floor("value").alias("lines_added"), F.col("user_id").alias("lines_removed"), F.col("props").alias("metadata"),
    )


_CH = """WITH changes AS (SELECT event_id AS change_id, user_id AS entity_id, event_type AS change_type, strftime(ts, '%a') AS entity_type, ts,
  CAST(floor(value) AS BIGINT) AS lines_added, user_id AS lines_removed, props AS metadata FROM events)"""


@R.add("change_stats_grouping_sets", _CH + """ SELECT change_type, entity_type, count(*) AS n, CAST(sum(lines_added) AS BIGINT) AS lines_added, CAST(sum(lines_removed) AS BIGINT) AS lines_removed
FROM changes GROUP BY GROUPING SETS ((change_type, entity_type), (change_type), (entity_type), ())""")
def _(t: Tables) -> DataFrame:
    return A.change_statistics(event_changes(t))


@R.add("hotspots", _CH + """ SELECT entity_id, count(*) AS n_changes, max(ts) AS last_change, max_by(metadata, (ts, change_id)) AS latest_metadata FROM changes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t: Tables) -> DataFrame:
    return A.hotspots(event_changes(t))


STATES = ("pending", "parsing", "parsed", "linking", "linked", "entities", "embedding", "ready", "skip", "error", "archived")


@R.add("state_histogram_zero_fill", f"""SELECT s.v AS node_state, count(n.uuid) AS n FROM (VALUES {', '.join(f"('{s}')" for s in STATES)}) s(v) LEFT JOIN nodes n ON n.node_state = s.v GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return A.histogram(t.nodes, "node_state", STATES)


@R.add("project_stats", """SELECT project_id, count(*) AS n, count(*) FILTER (node_state = 'error') AS n_errors, count(DISTINCT CASE WHEN node_state = 'error' THEN coalesce(error_type, 'unknown') END) AS n_error_types,
round(avg(CASE WHEN retry_count > 0 THEN retry_count END), 6) AS avg_retries, min(CASE WHEN node_state = 'pending' THEN updated_at END) AS oldest_pending FROM nodes GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return A.project_stats(t.nodes).withColumn("avg_retries", F.round("avg_retries", 6))


@R.add("progress", """SELECT count(*) FILTER (node_state IN ('ready', 'skip')) AS processed, count(*) AS total, CAST(round(100 * count(*) FILTER (node_state IN ('ready', 'skip')) / count(*)) AS BIGINT) AS percentage FROM nodes""")
def _(t: Tables) -> DataFrame:
    return A.progress(t.nodes, F.col("node_state").isin("ready", "skip"))


@R.add("coverage_percentage", """SELECT count(*) AS total, count(embedding) AS covered, count(*) - count(embedding) AS pending, 100.0::DOUBLE * count(embedding) / count(*) AS percentage FROM messages""")
def _(t: Tables) -> DataFrame:
    return A.coverage(t.messages, "embedding")


@R.add("token_estimate", "SELECT CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS prompt_tokens, count(*) * 150 AS response_tokens, (sum(ceil(length(text) / 4)) + count(*) * 150) * 0.5 / 1000 AS cost FROM documents")
def _(t: Tables) -> DataFrame:
    return A.token_estimate(t.documents, "text", cost_per_1k=0.5)


@R.add("max_score_per_group", "SELECT source, max(n_chars) AS n_chars FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return A.best_per(t.documents, "source", "n_chars")


@R.add("backfill_line_count", """SELECT f.file_uuid, f.recorded_at, coalesce(f.n_lines, m.v) AS n_lines FROM source_files f
LEFT JOIN (SELECT source_path, max(end_line) AS v FROM nodes GROUP BY 1) m ON m.source_path = f.source_path""")
def _(t: Tables) -> DataFrame:
    return A.backfill_max(t.source_files, "source_path", "n_lines", t.nodes, "source_path", "end_line").select("file_uuid", "recorded_at", "n_lines")


@R.add("counts_by_label", "SELECT 'nodes' AS label, count(*) AS n FROM nodes UNION ALL SELECT 'messages', count(*) FROM messages UNION ALL SELECT 'documents', count(*) FROM documents")
def _(t: Tables) -> DataFrame:
    return A.counts_by_label({"nodes": t.nodes, "messages": t.messages, "documents": t.documents})


@R.add("pipeline_scored_page", "SELECT o_orderkey, 1.0::DOUBLE AS score FROM orders WHERE o_totalprice > 200000 ORDER BY o_orderkey LIMIT 15 OFFSET 5")
def _(t: Tables) -> DataFrame:
    return Pipeline(shop(t), "orders", take=15, skip=5).where({"o_totalprice": {"gt": 200000}}).execute().select("o_orderkey", "score")


@R.add("pipeline_count", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def _(t: Tables) -> DataFrame:
    return Pipeline(shop(t), "orders").where({"o_totalprice": {"gt": 200000}}).where({"o_orderstatus": "O"}).count()
