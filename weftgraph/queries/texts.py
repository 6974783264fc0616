"""Text functions, conversations, source files and change streams as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.functions.ids import deterministic_uuid, sha256_hex, short_change_id
from weftgraph.operators import turns as T
from weftgraph.operators.entities import mention_graph
from weftgraph.operators.etl import line_diff
from weftgraph.plans.providers import EchoGenerator, HashingEmbedder, embed_column, generate
from weftgraph.queries.registry import Registry, Tables
from weftgraph.session import exists, shared_dir
from weftgraph.sources.files import SCOPES, code_scopes, data_file_references, data_file_sections, globbed, parser_name
from weftgraph.streaming import changes as S

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", sha256_hex(F.col("text")).alias("content_hash"))


@R.add("content_hash_fields", "SELECT uuid, recorded_at, sha256(concat_ws(chr(0), node_label, node_name, source_path)) AS digest FROM nodes")
def _(t: Tables) -> DataFrame:
    return t.nodes.select("uuid", "recorded_at", sha256_hex(F.col("node_label"), F.col("node_name"), F.col("source_path")).alias("digest"))


@R.add("deterministic_uuid", """SELECT source_path, upper(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) AS id
 FROM (SELECT DISTINCT source_path, sha256(source_path) AS h FROM source_files)""")
def _(t: Tables) -> DataFrame:
    return t.source_files.select("source_path").distinct().withColumn("id", deterministic_uuid(F.col("source_path")))


@R.add("change_ids", "SELECT event_id, left(sha256(concat_ws(':', CAST(user_id AS VARCHAR), event_type)), 16) AS change_id FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", short_change_id(F.col("user_id").cast("string"), F.col("event_type")).alias("change_id"))


@R.add("preprocess_whitespace", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS clean FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.collapse_blanks(F.col("text")).alias("clean"))


@R.add("preprocess_chain", r"""SELECT file_uuid, recorded_at, trim(regexp_replace(regexp_replace(regexp_replace(file_content, '/\*.*?\*/', '', 'gs'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[ \t\n\v\f\r]+', ' ', 'g')) AS clean FROM source_files""")
def _(t: Tables) -> DataFrame:
    block = lambda c: F.regexp_replace(c, r"(?s)/\*.*?\*/", "")
    return t.source_files.select("file_uuid", "recorded_at", X.preprocess(F.col("file_content"), [block, X.split_camel_case, X.collapse_blanks]).alias("clean"))


@R.add("preprocess_comments", r"""SELECT file_uuid, recorded_at, trim(regexp_replace(regexp_replace(file_content, '/\*.*?\*/', '', 'gs'), '(?m)(^|\s)//[^\n\r]*', '', 'g')) AS clean FROM source_files""")
def _(t: Tables) -> DataFrame:
    return t.source_files.select("file_uuid", "recorded_at", X.strip_comments(F.col("file_content")).alias("clean"))


@R.add("slugify", r"SELECT DISTINCT node_name, regexp_replace(regexp_replace(lower(trim(node_name)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM nodes WHERE node_name IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.nodes.where("node_name is not null").select("node_name", X.slugify(F.col("node_name")).alias("slug")).distinct()


@R.add("entity_keys", r"""SELECT DISTINCT node_label, node_name, node_label || ':' || lower(trim(node_name)) AS key, 'entity:' || lower(node_label) || ':' || regexp_replace(lower(trim(node_name)), '[^a-z0-9]', '_', 'g') AS id,
 regexp_replace(upper(node_label), '[^A-Z0-9_]', '_', 'g') AS rel FROM nodes WHERE node_name IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    a, b = F.col("node_label"), F.col("node_name")
    return t.nodes.where("node_name is not null").select(a, b, X.entity_key(a, b).alias("key"), X.entity_id(a, b).alias("id"), X.relation_type(a).alias("rel")).distinct()


@R.add("url_normalize", r"SELECT doc_id, CASE WHEN regexp_full_match(url, '[a-zA-Z][\w+.\-]*://\S+') THEN regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') ELSE url END AS url FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalize_url(F.col("url")).alias("url"))


@R.add("reference_kinds", r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(ref_source, '^(https?:)?//') THEN 'url' WHEN suffix(ref_source, '/') THEN 'directory'
 WHEN regexp_matches(ref_source, '(?i)\.(png|jpe?g|gif|svg|webp|ico|bmp)([?#]|$)') THEN 'image' WHEN regexp_matches(ref_source, '(?i)\.(json|ya?ml|toml|env|ini|xml)([?#]|$)') THEN 'config'
 WHEN regexp_matches(ref_source, '(?i)\.(tsx?|jsx?|py|go|rs|java|rb|css|scss|vue|svelte)([?#]|$)') THEN 'code' WHEN NOT regexp_matches(ref_source, '^[./]') AND NOT regexp_matches(ref_source, '\.\w{1,5}$') THEN 'package' ELSE 'file' END AS kind FROM extracted_refs) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return t.extracted_refs.select(X.reference_kind(F.col("ref_source")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@R.add("infer_types", r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN lower(trim(v)) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(trim(v), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN 'number' ELSE 'string' END AS kind
 FROM (SELECT regexp_extract(line, '^[\w.]+=(.+)$', 1) AS v FROM (SELECT unnest(string_split(replace(file_content, chr(13), ''), chr(10))) AS line FROM source_files) WHERE regexp_matches(line, '^[\w.]+=.+$'))) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    line = t.source_files.select(F.explode(F.split(F.replace("file_content", F.lit("\r"), F.lit("")), "\n", -1)).alias("line")).where(F.col("line").rlike(r"^[\w.]+=.+$"))
    return line.select(X.infer_typed(F.regexp_extract("line", r"^[\w.]+=(.+)$", 1)).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@R.add("json_props_extract", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_type", F.from_json("props", "k long")["k"].alias("k")).groupBy("event_type").agg(F.sum("k").alias("k"))


@R.add("chunk_documents", f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS d, doc_id AS id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
 l AS (SELECT d, id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
 p AS (SELECT d, id, row_number() OVER (PARTITION BY d ORDER BY i, k) - 1 AS i, substr(line, 1 + {X.MAX_CHARS} * k, {X.MAX_CHARS}) AS line FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(length(line) / {X.MAX_CHARS}) AS BIGINT)))) AS k FROM l)),
 c AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, count(*) OVER (PARTITION BY d) AS n FROM p),
 e AS (SELECT a.d, a.id, a.i, a.pos, a.n, greatest(a.i + 1, a.i + count(*) FILTER (b.pos + length(b.line) + CASE WHEN b.i < b.n - 1 THEN 1 ELSE 0 END <= a.pos + {X.MAX_CHARS})) AS stop FROM c a JOIN c b ON b.d = a.d AND b.i >= a.i AND b.i < a.i + {X.MAX_LINES} GROUP BY a.d, a.id, a.i, a.pos, a.n),
 w AS (SELECT d, i, stop, n FROM e WHERE i = 0 UNION ALL SELECT e.d, e.i, e.stop, e.n FROM w JOIN e ON e.d = w.d AND e.i = greatest(w.i + 1, w.stop - {X.OVERLAP}) WHERE w.stop < w.n),
 b AS (SELECT w.d, w.i, w.stop, any_value(c.id) AS id, min(c.pos) AS pos, string_agg(c.line, chr(10) ORDER BY c.i) AS text FROM w JOIN c ON c.d = w.d AND c.i >= w.i AND c.i < w.stop GROUP BY ALL)
 SELECT id, text, CAST(row_number() OVER (PARTITION BY d ORDER BY i) - 1 AS INTEGER) AS "index", CAST(pos AS INTEGER) AS start_char, CAST(pos + length(text) AS INTEGER) AS end_char, CAST(i + 1 AS INTEGER) AS start_line, CAST(stop AS INTEGER) AS end_line
 FROM b WHERE i = 0 OR length(text) >= {X.MIN_CHUNK}""")
def _(t: Tables) -> DataFrame:
    return X.chunks(t.documents, "doc_id", "text")


@R.add("chunk_need", """SELECT doc_id, coalesce(length(text) > 1500 OR len(string_split(text, chr(10))) > 30, false) AS needed,
 CASE WHEN length(text) > 1500 OR len(string_split(text, chr(10))) > 30 THEN CAST(greatest(ceil(length(text) / 1500), ceil(len(string_split(text, chr(10))) / 25)) AS BIGINT) ELSE 1 END AS estimate FROM documents""")
def _(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", F.coalesce(X.needs_chunking(c), F.lit(False)).alias("needed"), X.estimated_chunks(c).alias("estimate"))


_HEADS = r"""WITH RECURSIVE l AS (SELECT id, unnest(ls) AS line, unnest(range(len(ls))) AS i, len(ls) AS n FROM (SELECT DISTINCT {id} AS id, string_split(replace({text}, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM {table})),
 f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fences FROM l),
 h AS (SELECT id, i, n, length(regexp_extract(line, '^(#{{1,6}})\s', 1)) AS level, row_number() OVER (PARTITION BY id ORDER BY i) AS section_no FROM f
  WHERE coalesce(fences, 0) % 2 = 0 AND NOT regexp_matches(line, '^\s*(```|~~~)') AND regexp_matches(line, '^#{{1,6}}\s+\S'))"""


@R.add("markdown_sections", _HEADS.format(id="doc_id", text="text", table="documents") + """ SELECT h.id, CAST(h.section_no AS INTEGER) AS section_no, CAST(h.level AS INTEGER) AS level, CAST(h.i + 1 AS INTEGER) AS start_line,
 CAST(coalesce((SELECT min(x.i) FROM h x WHERE x.id = h.id AND x.section_no > h.section_no AND x.level <= h.level), any_value(h.n)) AS INTEGER) AS end_line,
 CAST((SELECT max(x.section_no) FROM h x WHERE x.id = h.id AND x.section_no < h.section_no AND x.level < h.level) AS INTEGER) AS parent_no FROM h GROUP BY h.id, h.section_no, h.level, h.i""")
def _(t: Tables) -> DataFrame:
    return X.sections(t.documents.select("doc_id", "text").distinct(), "doc_id").drop("title")


@R.add("document_headings", _HEADS.format(id="doc_id", text="text", table="documents") + " SELECT id, count(*) AS n FROM h GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return X.sections(t.documents.select("doc_id", "text").distinct(), "doc_id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@R.add("code_blocks", r"""SELECT doc_id AS id, len(regexp_extract_all(text, '(?ms)^```([\w+\-]*)[^\n]*\n(.*?)^```', 1)) AS n FROM documents WHERE len(regexp_extract_all(text, '(?ms)^```([\w+\-]*)[^\n]*\n(.*?)^```', 1)) > 0""")
def _(t: Tables) -> DataFrame:
    return X.code_blocks(t.documents, "doc_id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@R.add("extract_document_references", r"""SELECT DISTINCT doc_id AS id, 'link' AS kind, unnest(regexp_extract_all(text, '(?:^|[^!])\[[^\]\n]*\]\(([^)\s]+)[^)\n]*\)', 1)) AS target FROM documents
 UNION SELECT doc_id, 'image', unnest(regexp_extract_all(text, '!\[[^\]\n]*\]\(([^)\s]+)[^)\n]*\)', 1)) FROM documents UNION SELECT doc_id, 'url', unnest(regexp_extract_all(text, '\b(https?://[^\s<>\"'')\]]+)', 1)) FROM documents""")
def _(t: Tables) -> DataFrame:
    return X.extract_references(t.documents, F.lit("md"), "doc_id").distinct()


def files_by_language(t: Tables) -> DataFrame:
    """Distinct contents with their language, by the extension where the table names none."""
    lang = F.coalesce("file_lang", F.lower(F.regexp_extract("source_path", r"\.(\w+)$", 1)))
    return t.source_files.select("file_uuid", lang.alias("lang"), "file_content").distinct()


def _by_language(patterns: dict[str, dict[str, str]], out: str) -> str:
    """SQL of all patterns over all files, each for the languages that it belongs to. DuckDB's ``(?m)`` takes ``\\r`` for no
    line end, as Spark's takes it for one only with ``(?d)`` off, so both read ``\\s*`` before a line's first word alike."""
    langs = {"ts": "('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'vue', 'svelte')", "css": "('css', 'scss')"}
    parts = []
    for name, kinds in patterns.items():
        where = "" if name == "any" else f" WHERE lang IN {langs.get(name, repr((name,)).replace(',)', ')'))}"
        parts += [f"SELECT id, '{kind}' AS kind, unnest(regexp_extract_all(x, '" + p.replace("'", "''").replace("(?<!!)", "(?:^|[^!])") + f"', 1)) AS {out} FROM f{where}" for kind, p in kinds.items()]
    return "WITH f AS (SELECT DISTINCT file_uuid AS id, coalesce(file_lang, lower(regexp_extract(source_path, '\\.(\\w+)$', 1))) AS lang, file_content AS x FROM source_files) " + " UNION ALL ".join(parts)


@R.add("extract_file_references", f"SELECT DISTINCT * FROM ({_by_language(X.REFERENCE_PATTERNS, 'target')})")
def _(t: Tables) -> DataFrame:
    return X.extract_references(files_by_language(t), F.col("lang"), "file_uuid", "file_content").distinct()


@R.add("code_scopes", _by_language(SCOPES, "name"))
def _(t: Tables) -> DataFrame:
    return code_scopes(files_by_language(t), F.col("lang"), "file_uuid", "file_content")


@R.add("parser_dispatch", r"""SELECT p AS parser, count(*) AS n FROM (SELECT CASE WHEN e IN ('ts', 'tsx', 'js', 'jsx', 'py', 'go', 'css', 'scss') THEN 'code' WHEN e = 'md' THEN 'markdown' WHEN e IN ('json', 'yaml', 'env') THEN 'data' ELSE 'generic' END AS p
 FROM (SELECT lower(regexp_extract(source_path, '\.(\w+)$', 1)) AS e FROM source_files)) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return t.source_files.select(parser_name("source_path").alias("parser")).groupBy("parser").agg(F.count(F.lit(1)).alias("n"))


@R.add("glob_files", r"""SELECT source_path FROM source_files WHERE regexp_matches(source_path, '^(.*/)?[^/]*\.ts$') AND NOT regexp_matches(source_path, '/(node_modules|dist|\.git)/')""")
def _(t: Tables) -> DataFrame:
    return globbed(t.source_files, ["*.ts"], path_col="source_path").select("source_path")


def path_texts(t: Tables) -> DataFrame:
    return t.source_files.select(F.col("source_path").alias("path"), F.col("file_content").alias("text")).distinct()


@R.add("data_sections")
def _(t: Tables) -> DataFrame:
    return data_file_sections(path_texts(t)).drop("content")


@R.add("data_references")
def _(t: Tables) -> DataFrame:
    return data_file_references(path_texts(t))


@R.add("json_sections", r"""WITH RECURSIVE f AS (SELECT DISTINCT source_path AS path, CAST(file_content AS JSON) AS j FROM source_files WHERE suffix(lower(source_path), '.json') AND json_valid(file_content)),
 w AS (SELECT path, CAST(NULL AS VARCHAR) AS parent, j AS box, 0 AS depth, '' AS section FROM f
  UNION ALL SELECT w.path, w.section, c.v, w.depth + 1, CASE WHEN w.section = '' THEN c.k ELSE w.section || '.' || c.k END
  FROM w, LATERAL (SELECT CASE WHEN json_type(w.box) = 'ARRAY' THEN '[' || e.key || ']' ELSE e.key END AS k, max_by(e.value, e.id) AS v FROM json_each(w.box) e GROUP BY 1) c
  WHERE json_type(w.box) IN ('OBJECT', 'ARRAY') AND w.depth <= 10 AND (json_type(c.v) = 'OBJECT' AND len(list_distinct(json_keys(c.v))) >= 2 OR json_type(c.v) = 'ARRAY' AND json_array_length(c.v) >= 3))
 SELECT path, section, lower(json_type(box)) AS kind, CAST(CASE json_type(box) WHEN 'OBJECT' THEN len(list_distinct(json_keys(box))) ELSE json_array_length(box) END AS BIGINT) AS size,
  CAST(depth - 1 AS BIGINT) AS depth, nullif(parent, '') AS parent FROM w WHERE depth > 0""")
def _(t: Tables) -> DataFrame:
    return data_file_sections(path_texts(t).where(F.lower("path").endswith(".json"))).select("path", "section", "kind", "size", "depth", "parent")


_DM = ", ".join(f"('{d}', {len(ws)}, [{', '.join(repr(w) for w in ws)}])" for d, ws in X.DOMAINS.items())


@R.add("classify_domains", f"""SELECT id, domain, round(score, 6) AS score, round(least(score * 2, 1.0), 6) AS confidence FROM (SELECT doc_id AS id, d AS domain, len(list_filter(ws, lambda w: contains(lower(text), w)))::DOUBLE / n AS score
 FROM documents, (VALUES {_DM}) v(d, n, ws)) WHERE score > 0.3""")
def _(t: Tables) -> DataFrame:
    return X.domains(t.documents, "doc_id").withColumn("score", F.round("score", 6)).withColumn("confidence", F.round("confidence", 6))


@R.add("mention_graph", r"""SELECT 'entity:symbol:' || regexp_replace(lower(trim(s)), '[^a-z0-9]', '_', 'g') AS id, min('Symbol:' || lower(trim(s))) AS key, min(trim(s)) AS name, 'Symbol' AS type, count(*) AS n_mentions, count(DISTINCT source_path) AS n_documents
 FROM (SELECT source_path, confidence, unnest(symbols) AS s FROM extracted_refs) WHERE coalesce(confidence, 1) >= 0.5 GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    o = t.extracted_refs.select(F.col("source_path").alias("doc_id"), "confidence", F.explode("symbols").alias("name")).withColumn("type", F.lit("Symbol"))
    return mention_graph(o)[0]


@R.add("line_diff")
def _(t: Tables) -> DataFrame:
    s = t.source_files
    pair = s.groupBy("source_path").agg(F.min_by("file_content", "recorded_at").alias("old"), F.max_by("file_content", "recorded_at").alias("new"))
    return line_diff(pair, "old", "new").select("source_path", "change_type", "lines_added", "lines_removed")


@R.add("hash_embeddings", r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+'), lambda x: x <> '')) AS w FROM documents),
 h AS (SELECT doc_id, CAST('0x' || left(md5(w), 15) AS UBIGINT) AS h FROM w), c AS (SELECT doc_id, CAST(h % 64 AS INTEGER) AS place, sum(CASE WHEN (h // 64) % 2 = 1 THEN 1 ELSE -1 END) AS x FROM h GROUP BY 1, 2)
 SELECT doc_id, place, round(CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 5) AS value FROM c WHERE x <> 0""")
def _(t: Tables) -> DataFrame:
    v = embed_column(t.documents.select("doc_id", "text"), "text", "vec", HashingEmbedder())
    return v.select("doc_id", F.posexplode("vec").alias("place", "value")).where("value <> 0").select("doc_id", "place", F.round(F.col("value").cast("double"), 5).alias("value"))


@R.add("structured_generate_mock", "SELECT doc_id, left(text, 40) AS summary, CAST(length(text) AS BIGINT) AS length FROM documents WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null").select("doc_id", "text")
    return generate(d, EchoGenerator(), {"summary": "string", "length": "long"}).drop("text")


# conversations


def plain_messages(t: Tables) -> DataFrame:
    """Latest row of each message with readable role, in arrival order."""
    m = t.messages.where("conversation_id is not null")
    last = m.groupBy("uuid").agg(F.max(F.struct("recorded_at", "conversation_id", "msg_role", "msg_content", "char_count", F.size("tool_calls").alias("n_tools"))).alias("m")).select("uuid", "m.*")
    return last.select("uuid", "conversation_id", F.lower(F.trim("msg_role")).alias("role"), F.coalesce("msg_content", F.lit("")).alias("content"), F.struct("recorded_at", "uuid").alias("place"),
                       F.coalesce("n_tools", F.lit(0)).alias("n_tools"), F.coalesce("char_count", F.lit(0)).cast("long").alias("char_count"), F.col("recorded_at").alias("ts"))


_PM = """WITH m AS (SELECT uuid, conversation_id, lower(trim(msg_role)) AS role, coalesce(msg_content, '') AS content, recorded_at AS ts, coalesce(len(tool_calls), 0) AS n_tools, CAST(coalesce(char_count, 0) AS BIGINT) AS char_count
 FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY recorded_at DESC) AS rn FROM messages WHERE conversation_id IS NOT NULL) WHERE rn = 1)"""


@R.add("conversation_turns", _PM + r""", x AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY ts, uuid) AS turn_no FROM m WHERE role <> 'system')
 SELECT conversation_id, CAST(turn_no AS BIGINT) AS turn_no, max(CASE WHEN role = 'user' THEN content END) AS user_text, coalesce(max_by(CASE WHEN role <> 'user' AND regexp_matches(content, '[^\s\p{Z}]') THEN content END, CASE WHEN role <> 'user' AND regexp_matches(content, '[^\s\p{Z}]') THEN (ts, uuid) END), '') AS assistant_text,
  CAST(sum(CASE WHEN role <> 'user' THEN n_tools ELSE 0 END) AS BIGINT) AS n_tool_calls, max(CASE WHEN role <> 'user' THEN ts END) AS ts FROM x WHERE turn_no > 0 GROUP BY 1, 2
 HAVING count(CASE WHEN role <> 'user' AND regexp_matches(content, '[^\s\p{Z}]') THEN 1 END) > 0 OR sum(CASE WHEN role <> 'user' THEN n_tools ELSE 0 END) > 0""")
def _(t: Tables) -> DataFrame:
    return T.turns(plain_messages(t))


@R.add("recent_turns_budget", _PM + " SELECT uuid FROM (SELECT uuid, sum(char_count) OVER (PARTITION BY conversation_id ORDER BY ts DESC, uuid DESC ROWS UNBOUNDED PRECEDING) AS r FROM m) WHERE r <= 2000")
def _(t: Tables) -> DataFrame:
    return T.within_budget(plain_messages(t), "char_count", 2000).select("uuid")


@R.add("last_n_messages", _PM + " SELECT conversation_id, uuid, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY ts, uuid) AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ts DESC, uuid DESC) AS r FROM m) WHERE r <= 5")
def _(t: Tables) -> DataFrame:
    return T.last_n(plain_messages(t), 5).select("conversation_id", "uuid", "position")


@R.add("char_offsets", _PM + " SELECT uuid, CAST(e - char_count AS BIGINT) AS start_char, CAST(e AS BIGINT) AS end_char FROM (SELECT uuid, char_count, sum(char_count) OVER (PARTITION BY conversation_id ORDER BY ts, uuid ROWS UNBOUNDED PRECEDING) AS e FROM m)")
def _(t: Tables) -> DataFrame:
    return T.char_offsets(plain_messages(t), "char_count").select("uuid", "start_char", "end_char")


@R.add("summary_trigger", _PM + """, o AS (SELECT *, sum(char_count) OVER (PARTITION BY conversation_id ORDER BY ts, uuid ROWS UNBOUNDED PRECEDING) AS e FROM m),
 p AS (SELECT *, coalesce(sum(char_count) OVER (PARTITION BY conversation_id ORDER BY ts, uuid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM o WHERE e > 500)
 SELECT conversation_id, CAST(min(e - char_count) AS BIGINT) AS start_char, CAST(max(e) AS BIGINT) AS end_char, count(*) AS n_messages, CAST(sum(char_count) AS BIGINT) AS chars FROM p WHERE b < 1000 GROUP BY 1 HAVING sum(char_count) >= 1000""")
def _(t: Tables) -> DataFrame:
    m = plain_messages(t)
    done = m.select("conversation_id").distinct().withColumn("upto", F.lit(500))
    return T.summary_due(m, done, "char_count", max_context=10_000)


@R.add("conversation_counters", _PM + " SELECT conversation_id, count(*) AS message_count, CAST(sum(char_count) AS BIGINT) AS total_chars FROM m GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return T.conversation_counters(plain_messages(t))


@R.add("message_role_stats", _PM + " SELECT role, count(*) AS n, CAST(sum(n_tools) AS BIGINT) AS n_tools FROM m GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return plain_messages(t).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tools").alias("n_tools"))


@R.add("tool_call_stats", """SELECT tool_name, count(*) AS n, count(*) FILTER (success) AS n_ok, max(duration_ms) AS longest_ms FROM (SELECT c.tool_name, c.success, c.duration_ms FROM (SELECT unnest(tool_calls) AS c FROM messages)) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    c = t.messages.select(F.explode("tool_calls").alias("c")).select("c.*")
    return c.groupBy("tool_name").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("success"), 1)).alias("n_ok"), F.max("duration_ms").alias("longest_ms"))


@R.add("token_packs", _PM.replace("WITH m", "WITH RECURSIVE m") + """, o AS (SELECT conversation_id, uuid, CAST(ceil(char_count / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY conversation_id ORDER BY ts, uuid) AS i FROM m),
 w AS (SELECT conversation_id, uuid, i, CAST(0 AS BIGINT) AS pack, 1000 + tokens AS total, 1 AS n FROM o WHERE i = 1
  UNION ALL SELECT o.conversation_id, o.uuid, o.i, CASE WHEN w.total + o.tokens > 2500 OR w.n >= 20 THEN w.pack + 1 ELSE w.pack END, CASE WHEN w.total + o.tokens > 2500 OR w.n >= 20 THEN 1000 + o.tokens ELSE w.total + o.tokens END,
   CASE WHEN w.total + o.tokens > 2500 OR w.n >= 20 THEN 1 ELSE w.n + 1 END FROM w JOIN o ON o.conversation_id = w.conversation_id AND o.i = w.i + 1) SELECT uuid, pack FROM w""")
def _(t: Tables) -> DataFrame:
    m = plain_messages(t).withColumn("tokens", F.ceil(F.col("char_count") / 4)).withColumn("place", F.concat_ws(" ", F.lpad(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), 20, "0"), "uuid"))
    return T.pack_by_tokens(m.select("conversation_id", "uuid", "tokens", "place"), F.col("conversation_id"), "tokens", 2500).select("uuid", "pack")


@R.add("cascade_delete", _PM + " SELECT uuid FROM m WHERE conversation_id NOT IN (SELECT conversation_id FROM m WHERE role NOT IN ('user', 'assistant', 'system'))")
def _(t: Tables) -> DataFrame:
    m = plain_messages(t)
    gone = m.where("role not in ('user', 'assistant', 'system')").select("conversation_id")
    return T.cascade_delete(gone, messages=m)["messages"].select("uuid")


# change streams


def feed(t: Tables) -> DataFrame:
    """Events as file changes: the user is the path, some event types are creations and deletions."""
    k = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("updated")
    return t.events.select(F.col("user_id").alias("path"), k.alias("change_type"), F.col("event_id").alias("seq"), "ts")


_FD = "WITH f AS (SELECT user_id AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'updated' END AS k, event_id AS seq, ts, CAST(ts AS DATE) AS d FROM events)"


@R.add("coalesce_latest", _FD + """ SELECT path, CAST(d AS VARCHAR) AS d, CASE WHEN bool_or(k = 'deleted') THEN 'deleted' WHEN bool_or(k = 'updated') THEN 'updated' ELSE 'created' END AS change_type,
 coalesce(max(CASE WHEN k = 'deleted' THEN seq END), max(CASE WHEN k = 'updated' THEN seq END), min(seq)) AS seq FROM f GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    e = feed(t).withColumn("k", F.struct("path", F.to_date("ts").cast("string").alias("d")))
    return S.coalesce_changes(e, key="k").select("k.path", "k.d", "change_type", "seq")


@R.add("net_changes", _FD + " SELECT path, CAST(d AS VARCHAR) AS d, max_by(k, seq) AS change_type FROM f GROUP BY 1, 2 HAVING NOT (min_by(k, seq) = 'created' AND max_by(k, seq) = 'deleted')")
def _(t: Tables) -> DataFrame:
    e = feed(t).withColumn("k", F.struct("path", F.to_date("ts").cast("string").alias("d")))
    return S.net_changes(e, key="k").select("k.path", "k.d", "change_type")


def stream(t: Tables) -> DataFrame:
    return t.spark.readStream.schema(t.events.schema).parquet(t.folder, pathGlobFilter="events.parquet", recursiveFileLookup=True)


@R.add("tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    import uuid

    out = f"{shared_dir(t.spark)}/weftgraph/stream-{uuid.uuid4().hex}"
    q = S.tumbling(stream(t), "1 hour").writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/data")).outputMode("complete")
    q.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    # a stream without rows runs no batch and writes nothing
    return t.spark.read.parquet(f"{out}/data") if exists(t.spark, f"{out}/data") else S.tumbling(t.events.limit(0), "1 hour")


@R.add("sliding_counts", "SELECT w AS window_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 6 HOUR * i) AS w FROM events, range(0, 4) r(i)) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return S.sliding(t.events, "24 hours", "6 hours")


@R.add("session_gap", """SELECT user_id, session_no, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM (
 SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 21600000000 THEN 0 ELSE 1 END AS b FROM events)) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return S.gap_sessions(t.events, 6 * 3600)


@R.add("debounce_bursts", """SELECT path, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY path ORDER BY ts) AS s FROM (
 SELECT user_id AS path, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY path, s""")
def _(t: Tables) -> DataFrame:
    return S.debounce(feed(t), "6 hours")


@R.add("dedup_events", "SELECT DISTINCT user_id, event_type FROM events")
def _(t: Tables) -> DataFrame:
    return S.unique_within(t.events, ["user_id", "event_type"], "1 hour").select("user_id", "event_type")


@R.add("expired_keys", """SELECT user_id AS path, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 1 DAY""")
def _(t: Tables) -> DataFrame:
    return S.expired(feed(t), "2024-01-31", 1, ts="ts")
