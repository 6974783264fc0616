"""Search, ranking and fusion over documents, embeddings and code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import retrieval as V
from weftgraph.operators.entities import canonical_of_members, canonical_of_pairs, name_members, similar_names, similar_vectors_in_type
from weftgraph.queries.registry import Registry, Tables

R = Registry()
QUERIES, SQL = R.queries, R.sql


def first_vector(t: Tables):
    """The query vector: the one with the smallest id; one of no numbers, similar to nothing, if there is none."""
    first = t.embeddings.orderBy("vec_id").select("embedding").head()
    return V.literal_vector(first[0] if first else [])


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_SC = f"WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id AS id, e.label, {_COS} AS score FROM embeddings e, q)"


@R.add("vector_topk", _SC + " SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return V.vector_topk(t.embeddings, first_vector(t), 10, id_col="vec_id", vec_col="embedding").withColumn("score", F.round("score", 6))


@R.add("vector_topk_filtered", _SC + " SELECT id, round(score, 6) AS score FROM s WHERE label IN (1, 2, 3) ORDER BY score DESC, id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return V.vector_topk(t.embeddings, first_vector(t), 10, id_col="vec_id", vec_col="embedding", where=F.col("label").isin(1, 2, 3)).withColumn("score", F.round("score", 6))


@R.add("vector_threshold", _SC + " SELECT id, round(score, 6) AS score FROM s WHERE score >= 0.1")
def _(t: Tables) -> DataFrame:
    return V.vector_topk(t.embeddings, first_vector(t), None, 0.1, id_col="vec_id", vec_col="embedding").withColumn("score", F.round("score", 6))


@R.add("vector_topk_batch", """SELECT query, id, round(score, 6) AS score FROM (
 SELECT a.vec_id AS query, e.vec_id AS id, s.score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(s.score, 12) DESC, e.vec_id) AS rn
 FROM embeddings a JOIN embeddings e ON e.vec_id <> a.vec_id, LATERAL (SELECT list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) AS score) s WHERE a.vec_id % 20 = 0) WHERE rn <= 5""")
def _(t: Tables) -> DataFrame:
    q = t.embeddings.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec"))
    return V.batch_vector_topk(q, t.embeddings, 5, id_col="vec_id", vec_col="embedding").withColumn("score", F.round("score", 6))


@R.add("semantic_combine_03_07", _SC + " SELECT id, round(0.3 + 0.7 * score, 6) AS score FROM s WHERE label < 5")
def _(t: Tables) -> DataFrame:
    prior = t.embeddings.where("label < 5").select(F.col("vec_id").alias("id"), F.lit(1.0).alias("score"))
    scored = V.vector_topk(t.embeddings, first_vector(t), None, id_col="vec_id", vec_col="embedding")
    return V.semantic_step(prior, scored).withColumn("score", F.round("score", 6))


@R.add("legacy_merge", _SC + " SELECT id, round(0.3 + 0.7 * CASE WHEN score >= 0.2 THEN score ELSE 0 END, 6) AS score FROM s")
def _(t: Tables) -> DataFrame:
    prior = t.embeddings.select(F.col("vec_id").alias("id"), F.lit(1.0).alias("score"))
    scored = V.vector_topk(t.embeddings, first_vector(t), None, 0.2, id_col="vec_id", vec_col="embedding")
    return V.semantic_step(prior, scored, keep_misses=True).withColumn("score", F.round("score", 6))


@R.add("multi_embedding_max", _SC + " SELECT CAST(label AS BIGINT) AS uuid, round(max(score), 6) AS score FROM s GROUP BY 1")
def _(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("label").cast("long").alias("parent"), F.col("vec_id").alias("uuid"), F.col("embedding").alias("vec"))
    return V.multi_embedding_scores(e, first_vector(t), -1.0).withColumn("score", F.round("score", 6))


@R.add("best_chunk_per_parent", _SC + """ SELECT CAST(label AS BIGINT) AS id, round(greatest(max(score), CASE WHEN label IN (0, 3) THEN 0.5::DOUBLE END), 6) AS score, CAST(max_by(id, (round(score, 12), -id)) AS BIGINT) AS chunk FROM s GROUP BY label""")
def _(t: Tables) -> DataFrame:
    s = V.vector_topk(t.embeddings, first_vector(t), None, id_col="vec_id", vec_col="embedding").withColumn("score", F.round("score", 12))
    hits = s.join(t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("parent")), "id").select("parent", F.col("id").alias("chunk"), "score")
    direct = t.embeddings.where("label in (0, 3)").select(F.col("label").cast("long").alias("id"), F.lit(0.5).alias("score")).distinct()
    return V.best_chunk(hits, direct).withColumn("score", F.round("score", 6))


FIELDS = {"name": "doc_kind", "description": "source", "content": "text"}
_TERMS = {"name": "doc_kind", "description": "source", "content": "text"}


def _bm25_sql(terms: list[str], fuzzy: int = 0) -> str:
    same = f"levenshtein(x, q.t) <= {fuzzy}" if fuzzy else "x = q.t"
    parts = " UNION ALL ".join(
        f"SELECT doc_id AS id, '{f}' AS field, {w}::DOUBLE AS w, list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 0) AS terms FROM documents"
        for (f, c), w in zip(_TERMS.items(), (3, 2, 1))
    )
    values = ", ".join(f"('{x}')" for x in terms)
    return f"""WITH flat AS ({parts}), st AS (SELECT field, count(*) AS n, avg(len(terms)) AS avgdl FROM flat GROUP BY 1),
 tf AS (SELECT id, field, w, len(terms) AS len, q.t AS term, len(list_filter(terms, lambda x: {same})) AS tf FROM flat, (VALUES {values}) q(t)),
 hit AS (SELECT * FROM tf WHERE tf > 0), d AS (SELECT field, term, count(*) AS df FROM hit GROUP BY 1, 2),
 bm AS (SELECT id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgdl))) AS score, count(DISTINCT hit.term) AS nt
   FROM hit JOIN d ON d.field = hit.field AND d.term = hit.term JOIN st ON st.field = hit.field GROUP BY id HAVING nt = {len(terms)})"""


@R.add("bm25_topk", _bm25_sql(["cache", "version"]) + " SELECT id, round(score, 6) AS score FROM bm ORDER BY score DESC, id LIMIT 25")
def _(t: Tables) -> DataFrame:
    got = V.bm25(t.documents, FIELDS, "cache version", id_col="doc_id")
    return got.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "id").limit(25)


@R.add("fulltext_and_terms", _bm25_sql(["api", "parser", "edge"]) + " SELECT id FROM bm")
def _(t: Tables) -> DataFrame:
    return V.bm25(t.documents, FIELDS, "api parser edge", id_col="doc_id").select("id")


@R.add("fulltext_fuzzy", _bm25_sql(["parsr"], 1) + " SELECT id, round(score, 6) AS score FROM bm")
def _(t: Tables) -> DataFrame:
    return V.bm25(t.documents, FIELDS, "parsr", fuzzy=1, id_col="doc_id").withColumn("score", F.round("score", 6))


@R.add("postings_index", """SELECT 'content' AS field, term, doc_id AS id, count(*) AS tf, CAST(max(n) AS INTEGER) AS len FROM (SELECT doc_id, unnest(ts) AS term, len(ts) AS n FROM (
 SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 0) AS ts FROM documents WHERE text IS NOT NULL)) GROUP BY 2, 3""")
def _(t: Tables) -> DataFrame:
    return V.postings(t.documents.where("text is not null"), {"content": "text"}, "doc_id")


_HY = _bm25_sql(["cache", "version"]) + """, q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1),
 sem AS (SELECT vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, q),
 sc AS (SELECT * FROM sem WHERE score >= 0.15 ORDER BY score DESC, id LIMIT 60),
 lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(score, 9) AS score FROM bm ORDER BY 2 DESC, 1 LIMIT 60))"""


@R.add("hybrid_boost", _HY + """ SELECT id, round(score, 6) AS score, source FROM (
 SELECT sc.id, sc.score * CASE WHEN rank IS NULL THEN 1 ELSE 1 + 0.3 / sqrt(rank) END AS score, CASE WHEN rank IS NULL THEN 'semantic' ELSE 'both' END AS source FROM sc LEFT JOIN lex ON lex.id = sc.id
 UNION ALL SELECT id, 0.4 - 0.05 * (i - 1), 'lexical' FROM (SELECT id, row_number() OVER (ORDER BY rank) AS i FROM lex WHERE id NOT IN (SELECT id FROM sc)) WHERE i <= 5) ORDER BY score DESC, id LIMIT 20""")
def _(t: Tables) -> DataFrame:
    sem = V.vector_topk(t.embeddings, first_vector(t), None, id_col="vec_id", vec_col="embedding")
    lex = V.bm25(t.documents, FIELDS, "cache version", id_col="doc_id").withColumn("score", F.round("score", 9))
    return V.hybrid(sem, lex).withColumn("score", F.round("score", 6))


@R.add("rank_fusion", _HY + """, sl AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM sem ORDER BY score DESC, id LIMIT 60))
 SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM sl UNION ALL SELECT * FROM lex) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(t: Tables) -> DataFrame:
    sem = V.vector_topk(t.embeddings, first_vector(t), 60, id_col="vec_id", vec_col="embedding")
    lex = V.bm25(t.documents, FIELDS, "cache version", id_col="doc_id").withColumn("score", F.round("score", 9))
    return V.reciprocal_rank_fusion([sem, lex], depth=60).withColumn("score", F.round("score", 9)).orderBy(F.col("score").desc(), "id")


_ND = "(SELECT DISTINCT uuid, node_name, source_path, parser_name FROM nodes)"


@R.add("keyword_boost", f"""WITH w AS (SELECT uuid, field, kw, CASE WHEN trim(txt) = '' THEN 0 WHEN contains(txt, 'cache') OR contains(txt, 'tokenizer') THEN 1 ELSE
  coalesce(list_max(list_transform(list_filter(regexp_split_to_array(txt, '[\\s.\\-_/\\\\:,;()\\[\\]{{}}]+'), lambda x: length(x) > 2),
   lambda x: CASE WHEN x = kw THEN 1.0 ELSE 1 - levenshtein(x, kw)::DOUBLE / greatest(length(x), length(kw)) END)), 0) END AS s
  FROM (SELECT uuid, 'a' AS field, lower(coalesce(node_name, '')) AS txt FROM {_ND} UNION ALL SELECT uuid, 'b', lower(coalesce(source_path, '')) FROM {_ND} UNION ALL SELECT uuid, 'c', lower(coalesce(parser_name, '')) FROM {_ND}), (VALUES ('cache'), ('tokenizer')) k(kw))
 SELECT uuid, round(0.5 + CASE WHEN max(s) >= 0.6 THEN max(s) * 0.15 ELSE 0 END, 6) AS score FROM w GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    n = t.nodes.select("uuid", "node_name", "source_path", "parser_name").distinct().withColumn("score", F.lit(0.5))
    return V.keyword_boost(n, ["cache", "tokenizer"], ["node_name", "source_path", "parser_name"]).groupBy("uuid").agg(F.round(F.max("score"), 6).alias("score"))


def judged(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Vector scores, and a judge's for the vectors of some labels."""
    rows = V.vector_topk(t.embeddings, first_vector(t), None, id_col="vec_id", vec_col="embedding")
    ev = t.embeddings.where("label >= 3").select(F.col("vec_id").alias("id"), (F.col("label") / 9.5).alias("score"))
    return rows, ev


def _rr(expr: str) -> str:
    return _SC + f" SELECT id, round({expr}, 6) AS score FROM (SELECT id, score AS v, label / 9.5 AS j FROM s WHERE label >= 3 AND label / 9.5 >= 0.4)"


for _name, _how, _expr in (
    ("rerank_weighted", "weighted", "0.3 * v + 0.7 * j"), ("rerank_multiplicative", "multiplicative", "v * j"),
    ("rerank_override", "llm-override", "CASE WHEN j > 0.9 THEN j ELSE 0.5 * v + 0.5 * j END"),
):
    R.add(_name, _rr(_expr))(lambda t, how=_how: V.merge_reranked(*judged(t), how, 0.4).select("id", F.round("score", 6).alias("score")))


@R.add("class_boost", _SC + " SELECT id, round(CASE WHEN label = 1 AND score >= 0.7 THEN score * 1.1 ELSE score END, 6) AS score FROM s WHERE score >= 0.05")
def _(t: Tables) -> DataFrame:
    s = V.vector_topk(t.embeddings, first_vector(t), None, id_col="vec_id", vec_col="embedding")
    kind = t.embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("label") == 1, "class").otherwise("other").alias("type"))
    return V.finish_search(s.join(kind, "id"), 0.05).select("id", F.round("score", 6).alias("score"))


@R.add("type_boost", """SELECT uuid, recorded_at, round(least(1.0, 0.9::DOUBLE * CASE WHEN end_line - start_line > 20 THEN 1.05 WHEN end_line - start_line > 2 THEN 1.15 ELSE 0.95 END), 6) AS score FROM nodes WHERE start_line IS NOT NULL AND end_line IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    span = F.col("end_line") - F.col("start_line")
    n = t.nodes.withColumn("type", F.when(span > 20, "class").when(span > 2, "method").otherwise("variable")).withColumn("score", F.lit(0.9))
    return V.type_boost(n).select("uuid", "recorded_at", F.round("score", 6).alias("score"))


@R.add("rag_recency", """SELECT event_id AS id, round(value / 100 * CASE level WHEN 1 THEN 1.2 ELSE 1.0 END * (0.5 + 0.5 * exp(-(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400e6 / 7)), 6) AS score
 FROM (SELECT *, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS level FROM events) WHERE value / 100 > 0.3""")
def _(t: Tables) -> DataFrame:
    e = t.events.select(F.col("event_id").alias("id"), (F.col("value") / 100).alias("score"), "ts", F.when(F.col("event_type") == "view", 1).otherwise(0).alias("level"))
    return V.rag_score(e, 0.3, {1: 1.2}, 7, F.lit("2024-02-01").cast("timestamp")).select("id", F.round("score", 6).alias("score"))


@R.add("history_search", """SELECT DISTINCT doc_id AS id, CASE doc_kind WHEN 'issue' THEN 1 WHEN 'design_note' THEN 2 ELSE 0 END AS level, CASE doc_kind WHEN 'issue' THEN 0.7 WHEN 'design_note' THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM documents WHERE contains(lower(text), 'gateway')""")
def _(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_kind") == "issue", 1).when(F.col("doc_kind") == "design_note", 2).otherwise(0).alias("level"), "text")
    return V.history_hits(d.where("level = 0"), d.where("level > 0"), "gateway")


@R.add("grep_lines", """SELECT id, CAST(line_no AS INTEGER) AS line_no, line, regexp_extract(line, '(release \\d+\\.\\d+)', 1) AS "match" FROM (
 SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents) WHERE regexp_matches(line, 'release \\d+\\.\\d+') ORDER BY id, line_no LIMIT 100""")
def _(t: Tables) -> DataFrame:
    return V.grep(t.documents, r"release \d+\.\d+", id_col="doc_id").select("id", "line_no", "line", "match")


@R.add("grep_context", """SELECT id, CAST(line_no AS INTEGER) AS line_no, list_slice(ls, greatest(line_no - 2, 1), line_no - 1) AS before, list_slice(ls, line_no + 1, line_no + 2) AS after FROM (
 SELECT file_uuid AS id, string_split(file_content, chr(10)) AS ls, unnest(string_split(file_content, chr(10))) AS line, unnest(range(1, len(string_split(file_content, chr(10))) + 1)) AS line_no FROM (SELECT DISTINCT file_uuid, file_content FROM source_files)) WHERE regexp_matches(line, '(?i)todo|fixme')""")
def _(t: Tables) -> DataFrame:
    f = t.source_files.select("file_uuid", "file_content").distinct()
    return V.grep(f, "todo|fixme", ignore_case=True, id_col="file_uuid", text_col="file_content", context=2, limit=None).select("id", "line_no", "before", "after")


@R.add("grep_files_count", """SELECT file_lang, count(*) AS n FROM (SELECT file_lang, unnest(string_split(file_content, chr(10))) AS line FROM source_files) WHERE regexp_matches(line, 'async function \\w+') GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    g = V.grep(t.source_files.withColumn("id", F.struct("file_uuid", "recorded_at", "file_lang")), r"async function \w+", text_col="file_content", limit=None)
    return g.groupBy(F.col("id.file_lang").alias("file_lang")).agg(F.count(F.lit(1)).alias("n"))


_FW = """w AS (SELECT DISTINCT doc_id AS id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), lambda x: length(x) >= 3))) AS word FROM documents),
 s AS (SELECT id, word, k.k AS keyword, CASE WHEN word = k.k THEN 1.0 ELSE 1 - levenshtein(word, k.k)::DOUBLE / greatest(length(word), length(k.k)) END AS s FROM w, (VALUES ('tokenizer'), ('schema')) k(k))"""


@R.add("fuzzy_words", f"WITH {_FW} SELECT id, word, max_by(keyword, (s, keyword)) AS keyword, round(max(s), 2) AS similarity FROM s WHERE s >= 0.7 GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return V.fuzzy_words(t.documents, ["tokenizer", "schema"], id_col="doc_id", limit=None)


@R.add("fuzzy_words_all", f"WITH {_FW}, b AS (SELECT id, word, max_by(keyword, (s, keyword)) AS keyword FROM s WHERE s >= 0.7 GROUP BY 1, 2) SELECT DISTINCT id FROM b GROUP BY id HAVING count(DISTINCT keyword) = 2")
def _(t: Tables) -> DataFrame:
    return V.fuzzy_words(t.documents, ["tokenizer", "schema"], mode="all", id_col="doc_id", limit=None).select("id").distinct()


def part_entities(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), (F.col("p_size") / 50).alias("confidence"))


_PE = """e AS (SELECT p_brand AS type, p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1, 2),
 p AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, CASE WHEN a.name = b.name THEN 1.0 ELSE 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) END AS s FROM e a JOIN e b ON a.type = b.type AND a.id < b.id)"""


@R.add("dedup_fuzzy_pairs", f"WITH {_PE} SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.85")
def _(t: Tables) -> DataFrame:
    return similar_names(part_entities(t), 0.85).withColumn("similarity", F.round("similarity", 6))


@R.add("dedup_canonical", f"""WITH {_PE}, c AS (SELECT p_partkey AS id, p_size / 50 AS c, length(p_name) AS l FROM part)
 SELECT CASE WHEN (x.c, x.l) >= (y.c, y.l) THEN p.b ELSE p.a END AS id, max(CASE WHEN (x.c, x.l) >= (y.c, y.l) THEN p.a ELSE p.b END) AS canonical
 FROM p JOIN c x ON x.id = p.a JOIN c y ON y.id = p.b WHERE s >= 0.85 GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    e = part_entities(t)
    return canonical_of_pairs(e, similar_names(e, 0.85))


@R.add("dedup_members", "SELECT DISTINCT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS representative FROM part")
def _(t: Tables) -> DataFrame:
    return name_members(part_entities(t))


@R.add("dedup_canonical_members", """WITH m AS (SELECT *, first_value(p_partkey) OVER (PARTITION BY p_brand, p_name ORDER BY p_size DESC, p_partkey) AS lead FROM part),
 e AS (SELECT p_partkey AS id, p_brand AS type, p_name AS name, p_size AS c, length(p_name) AS l FROM m WHERE p_partkey = lead),
 p AS (SELECT x.id AS a, y.id AS b, (x.c, x.l) >= (y.c, y.l) AS keep FROM e x JOIN e y ON x.type = y.type AND x.id < y.id
  WHERE 1 - levenshtein(x.name, y.name)::DOUBLE / greatest(length(x.name), length(y.name)) >= 0.85),
 c AS (SELECT CASE WHEN keep THEN b ELSE a END AS id, max(CASE WHEN keep THEN a ELSE b END) AS canonical FROM p GROUP BY 1)
 SELECT p_partkey AS id, coalesce(c.canonical, lead) AS canonical FROM m LEFT JOIN c ON c.id = lead WHERE p_partkey <> coalesce(c.canonical, lead)""")
def _(t: Tables) -> DataFrame:
    return canonical_of_members(part_entities(t), 0.85)


@R.add("dedup_vector_pairs", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b
 ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.5""")
def _(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("type"), F.col("embedding").alias("vec"))
    return similar_vectors_in_type(e, 0.5).withColumn("similarity", F.round("similarity", 6))
