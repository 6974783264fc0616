"""Queries p1, p2, p5, p6, p8, p9 and p10 and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.conversations import conversation_defects, rebuild_conversations
from weftgraph.llm.leakage import renamed_leaks, verbatim_leaks
from weftgraph.llm.mixing import mixture, shares_reached
from weftgraph.llm.neighbours import neighbour_pairs
from weftgraph.llm.secrets import credentials, redact_files
from weftgraph.llm.source_origin import foreign_files
from weftgraph.llm.spam_pages import spam_pages
from weftgraph.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversation_defects(table(spark, d, "messages"))


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    return rebuild_conversations(table(spark, d, "messages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials(table(spark, d, "source_files")).select("file_uuid", "line_no").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact_files(table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_pairs(table(spark, d, "messages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return foreign_files(table(spark, d, "source_files"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return verbatim_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_renamed(spark: SparkSession, d: str) -> DataFrame:
    return renamed_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares_reached(p9_mixture(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_conversations": p1_conversations,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p8_found": p8_found,
    "p8_renamed": p8_renamed,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}

_BLANK = r"[\s\p{Z}\x{0085}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]"
_FACTS = rf"""
WITH latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY recorded_at DESC) AS rn
    FROM messages WHERE length(conversation_id) > 0) WHERE rn = 1),
trimmed AS (
  SELECT uuid, conversation_id, msg_content, tool_calls,
         lower(regexp_replace(msg_role, '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS role0,
         regexp_replace(msg_timestamp, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS t
  FROM latest),
facts AS (
  SELECT uuid, conversation_id, msg_content,
         CASE WHEN role0 IN ('user', 'assistant', 'system') THEN role0 ELSE 'other' END AS role,
         CASE WHEN regexp_full_match(t, '[+-]?\d+(\.\d+)?') THEN TRY_CAST(TRY_CAST(t AS DECIMAL(24, 6)) * 1000 AS BIGINT)
              WHEN regexp_matches(t, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}([T ]\d|$)') THEN epoch_us(TRY_CAST(t AS TIMESTAMPTZ)) END AS us,
         msg_content IS NOT NULL AND NOT regexp_full_match(msg_content, '{_BLANK}*') AS spoken,
         coalesce(len(tool_calls), 0) > 0 AS tools
  FROM trimmed),
talk AS (
  SELECT *, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS r FROM facts
  WHERE (spoken OR tools) AND role IN ('user', 'assistant') AND us IS NOT NULL),
heads AS (
  SELECT conversation_id, count(*) FILTER ((spoken OR tools) AND role IN ('user', 'assistant')) AS n,
         bool_or(role = 'other' OR us IS NULL) AS bad
  FROM facts GROUP BY conversation_id),
firsts AS (
  SELECT conversation_id, r FROM (
    SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY us, r, uuid) AS rn FROM talk) WHERE rn = 1),
gaps AS (
  SELECT DISTINCT conversation_id FROM (
    SELECT conversation_id, r, lead(r) OVER (PARTITION BY conversation_id ORDER BY us, r, uuid) AS nx
    FROM talk WHERE r = 0 OR spoken) WHERE r = 0 AND coalesce(nx, 0) = 0),
defects AS (
  SELECT h.conversation_id,
         CASE WHEN h.n = 0 THEN 'empty' WHEN h.bad OR f.r <> 0 THEN 'broken' WHEN g.conversation_id IS NOT NULL THEN 'no_reply' END AS defect
  FROM heads h LEFT JOIN firsts f USING (conversation_id) LEFT JOIN gaps g USING (conversation_id))
"""

SQL = {
    "p1_found": _FACTS + "SELECT conversation_id, defect FROM defects WHERE defect IS NOT NULL",
    "p1_conversations": _FACTS
    + """
SELECT f.conversation_id, row_number() OVER (PARTITION BY f.conversation_id
         ORDER BY us, CASE role WHEN 'system' THEN -1 WHEN 'user' THEN 0 ELSE 1 END, uuid) - 1 AS turn_no,
       role, uuid, make_timestamp(us) AS instant, msg_content
FROM facts f JOIN defects d ON d.conversation_id = f.conversation_id AND d.defect IS NULL
WHERE (spoken OR tools)""",
    # DuckDB composes canonically only; the tables hold no letters that compatibility composition changes further
    "p8_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS ws FROM (SELECT DISTINCT doc_id, text FROM documents)),
i AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(item_text)), '[\p{L}\p{N}]+') AS ws FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 11], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(ws[k : k + 11], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    # exact neighbours; the operator equals them where its parts are all visited, as at scale 0.01
    "p5_found": """
WITH v AS (SELECT uuid, max(CAST(embedding AS DOUBLE[])) AS vec FROM messages WHERE uuid IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
n AS (SELECT a.uuid AS a, b.uuid AS b, row_number() OVER (PARTITION BY a.uuid ORDER BY round(list_cosine_similarity(a.vec, b.vec), 12) DESC, b.uuid) AS r
  FROM v a JOIN v b ON a.uuid <> b.uuid)
SELECT DISTINCT least(a, b) AS uuid_a, greatest(a, b) AS uuid_b FROM n WHERE r <= 5""",
}
