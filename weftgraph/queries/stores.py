"""Incremental upserts, stored conversations, search, projects and crawls as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ids import sha256_hex
from weftgraph.functions.maps import drop_keys, merge_maps
from weftgraph.functions.patterns import any_label
from weftgraph.operators import aggregate as A
from weftgraph.operators import crawl as C
from weftgraph.operators import dialogue as D
from weftgraph.operators import ownership as O
from weftgraph.operators import search as S
from weftgraph.operators import upsert as U
from weftgraph.operators.etl import retry_queue
from weftgraph.plans.providers import PatternExtractor, extract_entities
from weftgraph.plans.query import get
from weftgraph.queries.registry import Registry, Tables
from weftgraph.queries.relational import shop
from weftgraph.queries.retrieval import FIELDS, _SC, _bm25_sql, first_vector
from weftgraph.queries.texts import _PM, plain_messages

R = Registry()
QUERIES, SQL = R.queries, R.sql


# incremental upserts: the first version of each node is what is stored, the current one what was parsed


def versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    n = t.nodes.where("uuid is not null").withColumn("_o", F.struct("updated_at", (-F.unix_micros(F.col("recorded_at").cast("timestamp"))).alias("r")))
    row = F.struct(F.col("node_label").alias("label"), F.col("content_hash").alias("hash"), F.upper(F.nullif("parent_uuid", F.lit(""))).alias("pid"), "deleted_at", "created_at", "node_name", "node_state")
    both = n.groupBy("uuid").agg(F.min_by(row, F.struct("updated_at", "recorded_at")).alias("a"), F.max_by(row, "_o").alias("b"))
    return both.select("uuid", "a.*").where("created_at < '2025-09-01'"), both.select("uuid", "b.*").where("deleted_at is null")


def parents(rows: DataFrame) -> DataFrame:
    return rows.where("pid is not null").select(F.col("uuid").alias("src"), F.col("pid").alias("dst"), F.lit("HAS_PARENT").alias("type"))


_ROW = "{'label': node_label, 'hash': content_hash, 'pid': upper(nullif(parent_uuid, '')), 'deleted_at': deleted_at, 'created_at': created_at, 'name': node_name, 'state': node_state}"
_V = f"""WITH v AS (SELECT uuid, min_by({_ROW}, (updated_at, recorded_at)) AS a, max_by({_ROW}, (updated_at, -epoch_us(recorded_at))) AS b FROM nodes WHERE uuid IS NOT NULL GROUP BY 1),
 o AS (SELECT uuid, a.label AS label, a.hash AS hash, a.pid AS pid FROM v WHERE a.created_at < TIMESTAMP '2025-09-01'),
 n AS (SELECT uuid, b.label AS label, b.hash AS hash, b.pid AS pid, b.name AS name, b.state AS state FROM v WHERE b.deleted_at IS NULL),
 oc AS (SELECT * FROM o WHERE hash IS NOT NULL AND label NOT IN ('File', 'Directory', 'Project')), nc AS (SELECT * FROM n WHERE hash IS NOT NULL AND label NOT IN ('File', 'Directory', 'Project')),
 ch AS (SELECT coalesce(nc.uuid, oc.uuid) AS uuid, CASE WHEN oc.uuid IS NULL THEN 'created' WHEN nc.uuid IS NULL THEN 'deleted' WHEN oc.hash <> nc.hash THEN 'updated' ELSE 'unchanged' END AS change FROM oc FULL JOIN nc ON nc.uuid = oc.uuid),
 w AS (SELECT * FROM n WHERE label IN ('File', 'Directory', 'Project') OR uuid IN (SELECT uuid FROM ch WHERE change IN ('created', 'updated')))"""


@R.add("upsert_stats", _V + " SELECT change, count(*) AS n FROM ch GROUP BY 1")
def _(t: Tables) -> DataFrame:
    old, new = versions(t)
    return U.upsert_graph(old, parents(old), new, parents(new))["stats"]


@R.add("upsert_nodes", _V + " SELECT uuid, hash FROM o WHERE uuid NOT IN (SELECT uuid FROM ch WHERE change = 'deleted') AND uuid NOT IN (SELECT uuid FROM w) UNION ALL SELECT uuid, hash FROM w")
def _(t: Tables) -> DataFrame:
    old, new = versions(t)
    return U.upsert_graph(old, parents(old), new, parents(new))["nodes"].select("uuid", "hash")


@R.add("upsert_edges", _V + """ SELECT uuid AS src, pid AS dst FROM o WHERE pid IS NOT NULL AND uuid NOT IN (SELECT uuid FROM ch WHERE change IN ('deleted', 'updated')) AND pid NOT IN (SELECT uuid FROM ch WHERE change = 'deleted')
 UNION SELECT uuid, pid FROM n WHERE pid IS NOT NULL AND (uuid IN (SELECT uuid FROM w) OR pid IN (SELECT uuid FROM w))""")
def _(t: Tables) -> DataFrame:
    old, new = versions(t)
    return U.upsert_graph(old, parents(old), new, parents(new))["edges"].select("src", "dst")


@R.add("create_nodes", "SELECT 'project' AS kind, project_id AS id FROM projects UNION ALL SELECT 'run', CAST(run_id AS VARCHAR) FROM ingest_runs")
def _(t: Tables) -> DataFrame:
    stored = t.projects.select(F.lit("project").alias("kind"), F.col("project_id").alias("id"))
    return U.create_nodes(stored, t.ingest_runs.select(F.lit("run").alias("kind"), F.col("run_id").cast("string").alias("id")), "id")


@R.add("file_changes", """WITH o AS (SELECT source_path AS path, min_by(sha256(file_content), recorded_at) FILTER (file_content IS NOT NULL) AS h FROM source_files WHERE recorded_at < TIMESTAMP '2025-07-01' GROUP BY 1),
 n AS (SELECT source_path AS path, max_by(sha256(file_content), recorded_at) FILTER (file_content IS NOT NULL) AS h FROM source_files WHERE recorded_at >= TIMESTAMP '2025-04-01' GROUP BY 1),
 d AS (SELECT DISTINCT source_path AS path FROM extracted_refs WHERE confidence < 0.5)
 SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN n.h IS NULL THEN 'error' WHEN o.path IS NULL THEN 'new' WHEN o.h IS DISTINCT FROM n.h OR n.path IN (SELECT path FROM d) THEN 'modified' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON n.path = o.path""")
def _(t: Tables) -> DataFrame:
    s = t.source_files.select(F.col("source_path").alias("path"), sha256_hex(F.col("file_content")).alias("hash"), "recorded_at")
    at = F.when(F.col("hash").isNotNull(), F.col("recorded_at"))
    old = s.where("recorded_at < '2025-07-01'").groupBy("path").agg(F.min_by("hash", at).alias("hash"))
    new = s.where("recorded_at >= '2025-04-01'").groupBy("path").agg(F.max_by("hash", at).alias("hash"))
    return U.file_changes(old, new, dirty=t.extracted_refs.where("confidence < 0.5").select(F.col("source_path").alias("path")))


@R.add("resumable_stages", """SELECT stage, count(*) AS n FROM (SELECT CASE WHEN node_state IN ('pending', 'parsing') THEN 'parse' WHEN node_state IN ('parsed', 'linking') THEN 'link' WHEN node_state IN ('linked', 'entities') THEN 'entities' WHEN node_state = 'embedding' THEN 'embed' END AS stage FROM nodes) WHERE stage IS NOT NULL GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return U.resumable(t.nodes).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@R.add("stored_hashes", "SELECT DISTINCT n.uuid, n.content_hash AS hash FROM nodes n WHERE n.content_hash IS NOT NULL AND n.uuid IN (SELECT upper(file_uuid) FROM source_files)")
def _(t: Tables) -> DataFrame:
    return U.stored_hashes(t.nodes.withColumnRenamed("content_hash", "hash"), t.source_files.select(F.upper("file_uuid").alias("uuid"))).distinct()


@R.add("capture_metadata", """SELECT 'Message' AS label, uuid, token_count, NULL AS parser_name FROM messages WHERE token_count IS NOT NULL UNION ALL SELECT 'Node', uuid, NULL, parser_name FROM nodes WHERE parser_name IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    return U.capture_metadata({"Message": t.messages, "Node": t.nodes, "Project": t.projects}, ["token_count", "parser_name"])


def vectors_of_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    fresh = t.embeddings.select(F.col("vec_id").alias("uuid"), F.col("label").cast("string").alias("hash"), F.lit(None).cast("array<float>").alias("vec"))
    old = t.embeddings.select(F.col("vec_id").alias("uuid"), F.when(F.col("label") > 2, F.col("label").cast("string")).otherwise("old").alias("hash"), F.when(F.col("label") > 4, "mock").otherwise("other").alias("provider"), F.col("embedding").alias("vec"))
    return fresh, old


@R.add("restore_vectors", "SELECT vec_id AS uuid, label > 4 AS restored FROM embeddings")
def _(t: Tables) -> DataFrame:
    fresh, old = vectors_of_parts(t)
    return U.restore_metadata(fresh, old, "mock", ["vec"]).select("uuid", F.col("vec").isNotNull().alias("restored"))


def doc_summaries(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null and lang in ('en', 'fr')")
    return d.select(F.col("doc_id").alias("id"), F.lit("short").alias("strategy"), F.when(F.col("lang") == "en", sha256_hex(F.col("text"))).otherwise("old").alias("hash"), F.substring("text", 1, 40).alias("summary"), F.col("captured_at").alias("ts"))


@R.add("summaries_due", """SELECT doc_id AS id, CASE WHEN lang = 'fr' THEN 'stale' ELSE 'missing' END AS reason FROM documents WHERE length(text) > 500 AND coalesce(lang, '') <> 'en'""")
def _(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("id"), "text", sha256_hex(F.col("text")).alias("hash"))
    return U.summaries_due(d, doc_summaries(t), 500, "short")


@R.add("cached_summaries", "SELECT doc_id AS id, left(text, 40) AS summary FROM documents WHERE lang = 'en' AND text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("id"), sha256_hex(F.col("text")).alias("hash"))
    return U.cached_summaries(d, U.store_summaries(doc_summaries(t).limit(0), doc_summaries(t)), "short")


_TREE = "n AS (SELECT uuid, max_by({'name': node_name, 'label': node_label, 'parser': parser_name}, (updated_at, recorded_at)) AS c FROM nodes WHERE uuid IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT upper(parent_uuid) AS src, uuid AS dst FROM nodes WHERE parent_uuid <> '')"


def tree(t: Tables) -> tuple[DataFrame, DataFrame]:
    n = t.nodes.where("uuid is not null").groupBy("uuid").agg(F.max_by(F.struct(F.col("node_name").alias("name"), F.col("node_label").alias("label"), F.col("parser_name").alias("parser")), F.struct("updated_at", "recorded_at")).alias("c"))
    return n.select(F.col("uuid").alias("id"), "c.*"), t.nodes.where("parent_uuid <> ''").select(F.upper("parent_uuid").alias("src"), F.col("uuid").alias("dst")).distinct()


@R.add("relationship_snippets", f"""WITH {_TREE}, l AS (SELECT DISTINCT e.src, n.c.name AS line FROM e JOIN n ON n.uuid = e.dst WHERE trim(n.c.name) <> ''),
 f AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY line) AS rn FROM l) SELECT src AS id, '[CONTAINS]' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS snippet FROM f WHERE rn <= 3 AND src IN (SELECT uuid FROM n) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    n, e = tree(t)
    return U.relationship_snippets(n.select("id"), e, n, "CONTAINS", limit=3)


@R.add("embedding_texts", f"""WITH {_TREE}, l AS (SELECT DISTINCT e.src, n.c.name AS line FROM e JOIN n ON n.uuid = e.dst WHERE trim(n.c.name) <> ''),
 f AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY line) AS rn FROM l), s AS (SELECT src, '[CONTAINS]' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS snippet FROM f WHERE rn <= 3 GROUP BY 1)
 SELECT uuid AS id, trim(concat_ws(chr(10) || chr(10), c.name, CASE WHEN trim(c.label) <> '' THEN c.label END, CASE WHEN trim(c.parser) <> '' THEN c.parser END, snippet)) AS text FROM n LEFT JOIN s ON s.src = uuid WHERE trim(c.name) <> ''""")
def _(t: Tables) -> DataFrame:
    n, e = tree(t)
    return U.embedding_texts(n, "name", ["label", "parser"], [U.relationship_snippets(n.select("id"), e, n, "CONTAINS", limit=3)])


@R.add("embedding_tasks", """SELECT DISTINCT doc_id AS id, CASE WHEN lang = 'en' THEN 'model' WHEN lang = 'fr' THEN 'content' WHEN lang = 'de' THEN 'provider' ELSE 'missing' END AS reason FROM documents WHERE length(trim(text)) >= 5 AND coalesce(lang, '') <> 'es'""")
def _(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("id"), "text", sha256_hex(F.col("text")).alias("hash"), F.lit(1).alias("start_line"))
    stored = t.documents.where("lang in ('en', 'fr', 'de', 'es') and text is not null").select(
        F.col("doc_id").alias("id"), F.when(F.col("lang") == "fr", "old").otherwise(sha256_hex(F.col("text"))).alias("hash"),
        F.when(F.col("lang") == "de", "other").otherwise("mock").alias("provider"), F.when(F.col("lang") == "en", "m1").otherwise("m2").alias("model"))
    return U.embedding_tasks(d, stored, "mock", "m2").select("id", "reason").distinct()


@R.add("stale_vectors", "SELECT coalesce(node_state, '-') AS state, count(*) AS n FROM nodes WHERE coalesce(node_state, '') NOT IN ('ready', 'embedded') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return U.stale_vectors(t.nodes).groupBy(F.coalesce("node_state", F.lit("-")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@R.add("change_records", """SELECT left(sha256(concat_ws(':', uuid, target_state, CAST(epoch_us(recorded_at) AS VARCHAR))), 16) AS change_id, node_label AS entity_type, uuid AS entity_id, target_state AS change_type FROM batch_transitions WHERE uuid IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    b = t.batch_transitions.where("uuid is not null")
    return U.change_records(b, F.col("node_label"), F.col("uuid"), F.col("target_state"), F.col("recorded_at"), {"model": F.col("embedding_model")}).drop("metadata", "ts")


# stored conversations


def calls(t: Tables) -> DataFrame:
    c = t.messages.where("conversation_id is not null").select(F.col("uuid"), F.explode("tool_calls").alias("c"))
    return c.select("uuid", F.col("c.uuid").alias("call_id"), F.col("c.tool_name").alias("tool_name"), F.col("c.success").cast("string").alias("output")).distinct()


@R.add("message_ordinals", _PM + " SELECT uuid, row_number() OVER (PARTITION BY conversation_id ORDER BY ts, uuid) - 1 AS ordinal FROM m")
def _(t: Tables) -> DataFrame:
    return D.message_ids(plain_messages(t)).select("uuid", "ordinal")


_CALLS = ", c AS (SELECT DISTINCT uuid, x.uuid AS call_id, x.tool_name AS tool_name, CAST(x.success AS VARCHAR) AS output FROM (SELECT uuid, unnest(tool_calls) AS x FROM messages WHERE conversation_id IS NOT NULL))"


@R.add("messages_with_tools", _PM + _CALLS + ", l AS (SELECT uuid, list_sort(list(call_id || ':' || tool_name || ':' || coalesce(output, '-'))) AS tools FROM c GROUP BY 1) SELECT m.uuid, coalesce(l.tools, []) AS tools FROM m LEFT JOIN l ON l.uuid = m.uuid")
def _(t: Tables) -> DataFrame:
    c = calls(t)
    got = D.messages_with_tools(plain_messages(t).select("uuid"), c.select("uuid", "call_id", "tool_name").distinct(), c.select("call_id", "output"))
    return got.select("uuid", F.transform("tools", lambda x: F.concat_ws(":", x["call_id"], x["tool_name"], F.coalesce(x["output"], F.lit("-")))).alias("tools"))


@R.add("session_view", _PM + _CALLS + """ SELECT s.conversation_id, count(DISTINCT m.uuid) AS n_messages, count(DISTINCT c.call_id) AS n_calls, min(m.ts) AS first_ts, max(m.ts) AS last_ts,
 coalesce(list_sort(list(DISTINCT c.tool_name) FILTER (c.tool_name IS NOT NULL)), []) AS tool_names FROM (SELECT DISTINCT conversation_id FROM messages WHERE conversation_id IS NOT NULL) s LEFT JOIN m ON m.conversation_id = s.conversation_id LEFT JOIN c ON c.uuid = m.uuid GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    s = t.messages.where("conversation_id is not null").select("conversation_id")
    return D.session_view(s, plain_messages(t), calls(t).select("uuid", "call_id", "tool_name").distinct())


def spoken_vectors(t: Tables) -> DataFrame:
    good = (F.size("embedding") == 64) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return t.messages.where(F.col("conversation_id").isNotNull() & good).select("uuid", "conversation_id", F.col("embedding").alias("vec")).distinct()


def probe() -> Column:
    return F.array(*(F.lit(float(i % 7 - 3)) for i in range(64)))


_MV = """WITH q AS (SELECT list_transform(range(64), lambda i: CAST(i % 7 - 3 AS DOUBLE)) AS q),
 v AS (SELECT DISTINCT uuid, conversation_id, CAST(embedding AS DOUBLE[]) AS vec FROM messages WHERE conversation_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 s AS (SELECT uuid, conversation_id, list_cosine_similarity(vec, q.q) AS score FROM v, q)"""


@R.add("similar_conversations", _MV + " SELECT conversation_id, round(max(score), 6) AS score FROM s WHERE score > 0.1 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return D.similar_conversations(spoken_vectors(t), probe(), 0.1, None).withColumn("score", F.round("score", 6))


@R.add("similar_messages", _MV + " SELECT uuid, round(score, 6) AS score FROM s WHERE score > 0 AND conversation_id = (SELECT min(conversation_id) FROM messages)")
def _(t: Tables) -> DataFrame:
    first = t.messages.agg(F.min("conversation_id")).head()[0]
    return D.similar_messages(spoken_vectors(t), first, probe(), 0.0, None).withColumn("score", F.round("score", 6))


@R.add("summary_sizes", """SELECT source AS conversation_id, CASE doc_kind WHEN 'issue' THEN 1 ELSE 2 END AS level, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, min(doc_id) AS start_turn, max(doc_id) AS end_turn FROM documents WHERE source IS NOT NULL GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return D.summary_sizes(t.documents.where("source is not null").select(F.col("source").alias("conversation_id"), F.when(F.col("doc_kind") == "issue", 1).otherwise(2).alias("level"), "text", F.col("doc_id").alias("start_turn"), F.col("doc_id").alias("end_turn")))


@R.add("ranked_history", """SELECT DISTINCT doc_id AS id, CASE doc_kind WHEN 'issue' THEN 1 WHEN 'design_note' THEN 2 ELSE 0 END AS level, CASE doc_kind WHEN 'issue' THEN 0.7 WHEN 'design_note' THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM documents WHERE contains(lower(text), 'router') ORDER BY 3 DESC, 1 LIMIT 20""")
def _(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_kind") == "issue", 1).when(F.col("doc_kind") == "design_note", 2).otherwise(0).alias("level"), "text")
    return D.ranked_history(d.where("level = 0"), d.where("level > 0"), "router")


@R.add("find_conversations", _PM + """, g AS (SELECT conversation_id, list(DISTINCT role) AS tags, max(ts) AS updated_at FROM m GROUP BY 1) SELECT conversation_id FROM g WHERE list_contains(tags, 'system') ORDER BY updated_at DESC, conversation_id LIMIT 25""")
def _(t: Tables) -> DataFrame:
    c = plain_messages(t).groupBy("conversation_id").agg(F.collect_set("role").alias("tags"), F.max("ts").alias("updated_at")).withColumn("status", F.lit("active"))
    return D.find_conversations(c, ["system"], "active", 25).select("conversation_id")


@R.add("conversation_status", _PM + " SELECT conversation_id, CASE WHEN conversation_id IN (SELECT conversation_id FROM m WHERE role = 'system') THEN 'archived' ELSE 'active' END AS status FROM m GROUP BY 1")
def _(t: Tables) -> DataFrame:
    c = plain_messages(t).select("conversation_id").distinct()
    none = t.spark.createDataFrame([], "conversation_id string, status string")
    return D.set_status(D.create_conversations(none, c), plain_messages(t).where("role = 'system'"), "archived").select("conversation_id", "status")


_EC = _PM + """, k AS (SELECT conversation_id AS id FROM m GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), own AS (SELECT m.* FROM m, k WHERE m.conversation_id = k.id),
 q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1),
 s AS (SELECT vec_id AS id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.q) AS score FROM embeddings, q),
 qu AS (SELECT uuid FROM (SELECT uuid, sum(char_count) OVER (ORDER BY ts DESC, uuid DESC ROWS UNBOUNDED PRECEDING) AS r FROM own WHERE role = 'user') WHERE r <= 1000),
 re AS (SELECT uuid FROM (SELECT uuid, sum(char_count) OVER (ORDER BY ts DESC, uuid DESC ROWS UNBOUNDED PRECEDING) AS r FROM own) WHERE r <= 1000),
 hi AS (SELECT id FROM s WHERE score > 0.05 ORDER BY score * CASE WHEN label > 5 THEN 0.5 ELSE 0.7 END DESC, id LIMIT 20),
 co AS (SELECT id FROM (SELECT id, sum(100) OVER (ORDER BY score DESC, id DESC ROWS UNBOUNDED PRECEDING) AS r FROM s WHERE score >= 0.05) WHERE r <= 2000)
 SELECT 'queries' AS part, uuid AS id FROM qu UNION ALL SELECT 'recent', uuid FROM re UNION ALL SELECT 'history', CAST(id AS VARCHAR) FROM hi UNION ALL SELECT 'code', CAST(id AS VARCHAR) FROM co UNION ALL SELECT 'open', CAST(vec_id AS VARCHAR) FROM embeddings WHERE label IN (1, 3, 5)"""


@R.add("enriched_context", _EC)
def _(t: Tables) -> DataFrame:
    m = plain_messages(t)
    most = m.groupBy("conversation_id").count().orderBy(F.col("count").desc(), "conversation_id").head()
    one = most[0] if most else ""
    v = t.embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    summaries = v.select("id", F.lit(one).alias("conversation_id"), F.when(F.col("label") > 5, 2).otherwise(1).alias("level"), (~F.col("label").isin(1, 3, 5)).alias("covered"), "vec", F.lit(None).cast("timestamp").alias("ts"))
    said = m.select("uuid", "conversation_id", "role", "place", F.col("char_count").alias("chars"), F.lit(None).cast("array<float>").alias("vec"), "ts").withColumn("uuid", F.col("uuid"))
    summaries = summaries.withColumn("id", F.col("id").cast("string"))
    parts = D.enriched_context(said, summaries, v.select("id", "vec", F.lit(100).alias("chars")), one, first_vector(t), max_context=20_000, minimum=0.05)
    out = None
    for name, key in (("queries", "uuid"), ("recent", "uuid"), ("history", "id"), ("code", "id"), ("open", "id")):
        part = parts[name].select(F.lit(name).alias("part"), F.col(key).cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


# search


@R.add("search_lexical", _bm25_sql(["cache", "version"]) + " SELECT doc_id, round(score, 6) AS score FROM (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20) JOIN documents ON doc_id = id WHERE regexp_matches(coalesce(doc_kind, ''), '.*_.*')")
def _(t: Tables) -> DataFrame:
    return S.search(t.documents.where("doc_id is not null"), "cache version", fields=FIELDS, fuzzy=0, glob="**_**", path_col="doc_kind", id_col="doc_id").select("doc_id", F.round("score", 6).alias("score"))


@R.add("search_semantic", _SC + " SELECT id AS vec_id, round(CASE WHEN label = 1 AND score >= 0.7 THEN score * 1.1 ELSE score END, 6) AS score FROM (SELECT * FROM s WHERE score >= 0.05 AND label <> 4 ORDER BY round(score, 12) DESC, id LIMIT 30)")
def _(t: Tables) -> DataFrame:
    e = t.embeddings.withColumn("type", F.when(F.col("label") == 1, "class").otherwise("other"))
    got = S.search(e, vector=first_vector(t), fields={}, mode="semantic", where=F.col("label") != 4, limit=30, minimum=0.05, id_col="vec_id", vec_col="embedding")
    return got.select("vec_id", F.round("score", 6).alias("score"))


@R.add("search_post_processed", _SC + " SELECT id, round(0.3 * score + 0.7 * label / 9.5, 6) AS score FROM s WHERE label >= 3 ORDER BY round(0.3 * score + 0.7 * label / 9.5, 12) DESC, id LIMIT 15")
def _(t: Tables) -> DataFrame:
    hits = S.search(t.embeddings, vector=first_vector(t), fields={}, mode="semantic", limit=None, minimum=-1.0, id_col="vec_id", vec_col="embedding").select(F.col("vec_id").alias("id"), "score")
    ev = t.embeddings.where("label >= 3").select(F.col("vec_id").alias("id"), (F.col("label") / 9.5).alias("score"))
    return S.post_process(hits, evaluations=ev, limit=15)["results"].select("id", F.round("score", 6).alias("score"))


@R.add("grep_files_context", r"""SELECT path, CAST(line_no AS INTEGER) AS line_no, list_slice(ls, greatest(line_no - 1, 1), line_no - 1) AS before FROM (
 SELECT path, string_split(x, chr(10)) AS ls, unnest(string_split(x, chr(10))) AS line, unnest(range(1, len(string_split(x, chr(10))) + 1)) AS line_no FROM (SELECT DISTINCT source_path AS path, file_content AS x FROM source_files WHERE regexp_matches(source_path, '^(.*/)?[^/]*\.go$') AND NOT regexp_matches(source_path, '/(node_modules|dist|\.git)/'))) WHERE regexp_matches(line, 'return \w+')""")
def _(t: Tables) -> DataFrame:
    f = t.source_files.select(F.col("source_path").alias("path"), F.col("file_content").alias("text")).distinct()
    return S.grep_files(f, r"return \w+", ["*.go"], context=1, limit=None).select(F.col("id").alias("path"), "line_no", "before")


@R.add("consumes_wrapper", "SELECT DISTINCT p_partkey FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_name = (SELECT min(s_name) FROM supplier) AND p_size > 10")
def _(t: Tables) -> DataFrame:
    first = t.supplier.agg(F.min("s_name")).head()[0]
    c = shop(t)
    supplier = c.relationships["SUPPLIED_BY"].target
    c.entities[supplier] = type(c.entity(supplier))(supplier, c.entity(supplier).rows, c.entity(supplier).key, "s_name")
    return get(c, c.relationships["SUPPLIED_BY"].source).consumes(first, "SUPPLIED_BY").raw("p_size > :least", least=10).compile().select("p_partkey")


@R.add("filter_labels", "SELECT uuid, recorded_at FROM nodes WHERE list_has_any([node_label, parser_name], ['Scope', 'markdown'])")
def _(t: Tables) -> DataFrame:
    return t.nodes.where(any_label(F.array("node_label", "parser_name"), ["Scope", "markdown"])).select("uuid", "recorded_at")


@R.add("members_by_group", "SELECT node_label, n, list_slice(ms, 1, 5) AS members FROM (SELECT node_label, count(DISTINCT parser_name) AS n, list_sort(list(DISTINCT parser_name) FILTER (parser_name IS NOT NULL)) AS ms FROM nodes WHERE parser_name IS NOT NULL AND node_label IS NOT NULL GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    return A.members_by(t.nodes.where("node_label is not null"), ["node_label"], "parser_name", 5)


# projects


@R.add("projects_excluded", "SELECT project_id, NOT coalesce(is_excluded, false) AS is_excluded FROM projects")
def _(t: Tables) -> DataFrame:
    ids = [r[0] for r in t.projects.select("project_id").collect()]
    return O.set_excluded(t.projects, ids, None).select("project_id", "is_excluded")


def a_project(t: Tables) -> tuple[str, str]:
    r = t.projects.orderBy("project_id").head()
    return (r["project_id"], r["root_path"]) if r else ("", "")


@R.add("rehome_orphans", """WITH p AS (SELECT project_id, root_path FROM projects ORDER BY project_id LIMIT 1) SELECT n.uuid, n.recorded_at, CASE WHEN n.project_id = p.project_id AND (source_path = root_path OR starts_with(source_path, root_path || '/')) THEN 'new' ELSE n.project_id END AS project_id,
 CASE WHEN n.project_id = p.project_id AND (source_path = root_path OR starts_with(source_path, root_path || '/')) THEN substr(source_path, length(root_path) + 2) ELSE source_path END AS source_path FROM nodes n LEFT JOIN p ON true""")
def _(t: Tables) -> DataFrame:
    pid, root = a_project(t)
    return O.rehome(t.nodes.select("uuid", "recorded_at", "project_id", "source_path"), pid, "new", root)


@R.add("merge_child_project", "WITH p AS (SELECT project_id FROM projects ORDER BY project_id LIMIT 1) SELECT n.uuid, n.recorded_at, CASE WHEN n.project_id = p.project_id THEN 'top/sub/' || source_path ELSE source_path END AS source_path FROM nodes n LEFT JOIN p ON true")
def _(t: Tables) -> DataFrame:
    return O.merge_project(t.nodes.select("uuid", "recorded_at", "project_id", "source_path"), a_project(t)[0], "top", "top/sub").select("uuid", "recorded_at", "source_path")


@R.add("matching_projects", "SELECT project_id FROM projects, (SELECT min(root_path) || '/src/x' AS q FROM projects) WHERE starts_with(q, root_path || '/') OR q = root_path OR starts_with(root_path, q || '/') ORDER BY length(root_path) DESC, project_id")
def _(t: Tables) -> DataFrame:
    path = (t.projects.agg(F.min("root_path")).head()[0] or "") + "/src/x"
    return O.matching_projects(t.projects, path).select("project_id")


@R.add("pending_counts", "SELECT project_id, node_state AS state, count(*) AS n_nodes, count(DISTINCT source_path) AS n_files FROM nodes WHERE coalesce(node_state, '') NOT IN ('ready', 'skip') GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return O.pending_counts(t.nodes)


@R.add("delete_project", "WITH p AS (SELECT project_id FROM projects ORDER BY project_id LIMIT 1) SELECT p.project_id, count(n.uuid) AS n_nodes, true AS existed FROM p LEFT JOIN nodes n ON n.project_id = p.project_id GROUP BY 1 UNION ALL SELECT 'nowhere', 0, false")
def _(t: Tables) -> DataFrame:
    edges = t.nodes.where("parent_uuid <> ''").select(F.col("uuid").alias("src"), F.upper("parent_uuid").alias("dst"))
    return O.delete_projects(t.nodes, edges, t.projects, [a_project(t)[0], "nowhere"])["deleted"]


@R.add("garbage", """SELECT 'node' AS kind, uuid AS id, count(*) AS n FROM nodes WHERE project_id NOT IN (SELECT project_id FROM projects WHERE project_id IS NOT NULL) OR project_id IS NULL GROUP BY 1, 2
 UNION ALL SELECT 'chunk', CAST(ref_id AS VARCHAR), count(*) FROM extracted_refs WHERE upper(file_uuid) NOT IN (SELECT uuid FROM nodes WHERE uuid IS NOT NULL) OR file_uuid IS NULL GROUP BY 1, 2 UNION ALL SELECT 'project', project_id, 1 FROM projects WHERE project_id NOT IN (SELECT project_id FROM nodes WHERE project_id IS NOT NULL)""")
def _(t: Tables) -> DataFrame:
    chunks = t.extracted_refs.select(F.col("ref_id").cast("string").alias("chunk_id"), F.upper("file_uuid").alias("parent"))
    g = O.garbage(t.nodes, t.projects, chunks)
    part = lambda d, kind, c: d.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return part(g["nodes"], "node", "uuid").unionByName(part(g["chunks"], "chunk", "chunk_id")).unionByName(part(g["projects"], "project", "project_id"))


# crawls: each node is a page that links to its parent's


def node_pages(t: Tables) -> DataFrame:
    n = t.nodes.where("uuid is not null").groupBy("uuid").agg(F.max_by(F.struct("node_name", F.upper(F.nullif("parent_uuid", F.lit(""))).alias("pid")), F.struct("updated_at", "recorded_at")).alias("c"))
    link = F.when(F.col("c.pid").isNotNull(), F.concat(F.lit('<a href="/'), "c.pid", F.lit('">up</a>'))).otherwise("")
    return n.select(F.concat(F.lit("https://h.test/"), "uuid").alias("url"), F.concat(F.lit("<title>"), F.coalesce("c.node_name", F.lit("")), F.lit("</title>"), link).alias("html"))


_PG = "WITH RECURSIVE n AS (SELECT uuid, max_by({'pid': upper(nullif(parent_uuid, ''))}, (updated_at, recorded_at)) AS c FROM nodes WHERE uuid IS NOT NULL GROUP BY 1), l AS (SELECT uuid AS src, c.pid AS dst FROM n WHERE c.pid IN (SELECT uuid FROM n) AND c.pid <> uuid)"


@R.add("crawl_pages", _PG + """, w(node, depth) AS (SELECT max(uuid), 0 FROM n UNION SELECT l.dst, w.depth + 1 FROM w JOIN l ON l.src = w.node WHERE w.depth < 2)
 SELECT 'https://h.test/' || node AS url, min(depth) AS depth FROM w GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    last = t.nodes.agg(F.max("uuid")).head()[0]
    return C.crawl(node_pages(t), [f"https://h.test/{last}"])


@R.add("site_graph", _PG + " SELECT 'HAS_PAGE' AS type, count(*) AS n FROM n UNION ALL SELECT 'LINKS_TO', count(*) FROM l")
def _(t: Tables) -> DataFrame:
    return C.site_graph(node_pages(t))[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# smaller parts


@R.add("retry_queue", "SELECT uuid, updated_at FROM nodes WHERE node_state = 'error' AND coalesce(retry_count, 0) < 3 ORDER BY coalesce(retry_count, 0), updated_at, uuid LIMIT 40")
def _(t: Tables) -> DataFrame:
    return retry_queue(t.nodes, 40).select("uuid", "updated_at")


@R.add("sample_by_label", "SELECT node_label, uuid FROM (SELECT *, row_number() OVER (PARTITION BY node_label ORDER BY uuid) AS rn FROM (SELECT DISTINCT node_label, uuid FROM nodes)) WHERE rn <= 3")
def _(t: Tables) -> DataFrame:
    return A.sample_by(t.nodes.select("node_label", "uuid").distinct(), "node_label", 3, "uuid")


@R.add("order_by_priority", "SELECT uuid, recorded_at FROM nodes ORDER BY CASE node_state WHEN 'error' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END, updated_at DESC, uuid, recorded_at LIMIT 50")
def _(t: Tables) -> DataFrame:
    rank = F.when(F.col("node_state") == "error", 0).when(F.col("node_state") == "pending", 1).otherwise(2)
    return t.nodes.orderBy(rank, F.col("updated_at").desc(), "uuid", "recorded_at").limit(50).select("uuid", "recorded_at")


@R.add("extracted_entities", r"SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(text, '\b[a-z]+(?:[A-Z][a-z0-9]+)+\b')) AS name, 'Symbol' AS type, 0.5::DOUBLE AS confidence FROM documents WHERE trim(text) <> ''")
def _(t: Tables) -> DataFrame:
    return extract_entities(t.documents, PatternExtractor(), id_col="doc_id").distinct()


@R.add("merged_maps", """SELECT event_id, event_type || '!' AS kind, CAST(user_id AS VARCHAR) AS usr, 2 AS n FROM events""")
def _(t: Tables) -> DataFrame:
    a = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("usr"), F.col("user_id").cast("string"), F.lit("x"), F.lit("1"))
    b = F.create_map(F.lit("kind"), F.concat("event_type", F.lit("!")))
    m = drop_keys(merge_maps(a, F.lit(None).cast("map<string,string>"), b), ["x"])
    return t.events.select("event_id", m.alias("m")).select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["usr"].alias("usr"), F.size("m").alias("n"))
