"""Queries p3, p4 and p7: hierarchies, incremental processing, orphan references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.operators.hierarchy import all_descendants, full_hierarchy, misplaced_nodes
from weftgraph.operators.incremental import nodes_to_process
from weftgraph.operators.orphans import EXTENSIONS, FILE_LABELS, INDEX_FILES, orphan_references, orphan_report
from weftgraph.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return misplaced_nodes(table(spark, d, "nodes"))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return full_hierarchy(table(spark, d, "nodes"), ancestors=False)


def p3_whole(spark: SparkSession, d: str) -> DataFrame:
    return full_hierarchy(table(spark, d, "nodes"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return all_descendants(table(spark, d, "nodes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nodes_to_process(table(spark, d, "nodes"), table(spark, d, "ingest_runs"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "nodes"), table(spark, d, "batch_transitions"), table(spark, d, "extracted_refs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_hierarchy": p3_hierarchy,
    "p3_whole": p3_whole,
    "p3_descendants": p3_descendants,
    "p4_found": p4_found,
    "p7_found": p7_found,
    "p7_report": p7_report,
}

_LIVE = """
cur AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY upper(uuid) ORDER BY updated_at DESC NULLS LAST, recorded_at ASC NULLS LAST) AS rn
    FROM nodes WHERE uuid IS NOT NULL AND trim(uuid) <> '') WHERE rn = 1),
live AS (
  SELECT upper(uuid) AS id, nullif(upper(trim(parent_uuid)), '') AS pid, node_depth, coalesce(node_name, '') AS name,
         content_hash, recorded_at
  FROM cur WHERE deleted_at IS NULL)
"""

_WALK = f"""
WITH RECURSIVE {_LIVE},
walk AS (
  SELECT id, id AS root, CAST(0 AS BIGINT) AS depth, name AS path FROM live
  WHERE pid IS NULL OR pid NOT IN (SELECT id FROM live)
  UNION ALL
  SELECT c.id, w.root, w.depth + 1, w.path || '/' || c.name FROM walk w JOIN live c ON c.pid = w.id)
"""

_P3 = f"""{_WALK}
SELECT l.id AS uuid, coalesce(w.root, '') AS root_uuid, coalesce(w.depth, -1) AS real_depth
FROM live l LEFT JOIN walk w ON w.id = l.id
WHERE w.id IS NULL OR l.node_depth IS NULL OR l.node_depth <> w.depth
"""

_P3_ALL = f"""{_WALK},
pairs AS (
  SELECT w.id AS anc, w.id AS node FROM walk w
  UNION ALL
  SELECT p.anc, c.id FROM pairs p JOIN live c ON c.pid = p.node)
SELECT l.id AS uuid, coalesce(w.root, '') AS root_uuid, coalesce(w.depth, -1) AS real_depth, w.path AS path,
       coalesce(n.n, 0) AS n_descendants
FROM live l LEFT JOIN walk w ON w.id = l.id
LEFT JOIN (SELECT anc, CAST(count(*) - 1 AS BIGINT) AS n FROM pairs GROUP BY anc) n ON n.anc = l.id
"""

_P3_WHOLE = _P3_ALL.replace("name AS path FROM live", "name AS path, CAST([] AS VARCHAR[]) AS chain FROM live").replace(
    "w.path || '/' || c.name FROM walk", "w.path || '/' || c.name, list_append(w.chain, w.id) FROM walk"
).replace("w.path AS path,", "w.path AS path, w.chain AS ancestors,")

_P3_PAIRS = f"""{_WALK},
pairs AS (
  SELECT w.id AS anc, w.id AS node, CAST(0 AS BIGINT) AS d FROM walk w
  UNION ALL
  SELECT p.anc, c.id, p.d + 1 FROM pairs p JOIN live c ON c.pid = p.node)
SELECT anc AS ancestor, node AS descendant, d AS distance FROM pairs WHERE d > 0
"""

_P4 = f"""
WITH {_LIVE},
done AS (
  SELECT * FROM (
    SELECT upper(uuid) AS id, lower(content_hash) AS h,
           row_number() OVER (PARTITION BY upper(uuid) ORDER BY updated_at DESC, recorded_at ASC) AS rn
    FROM nodes n
    WHERE node_state IN ('ready', 'skip') AND deleted_at IS NULL
      AND EXISTS (SELECT 1 FROM ingest_runs r WHERE r.run_id = n.run_id AND r.run_status = 'success')) WHERE rn = 1)
SELECT l.id AS uuid FROM live l LEFT JOIN done d ON d.id = l.id
WHERE d.h IS NULL OR lower(l.content_hash) IS DISTINCT FROM d.h
"""

_LABELS = ", ".join(f"'{x}'" for x in FILE_LABELS)
_SUFFIXES = ", ".join(f"('{x}')" for x in ("", *EXTENSIONS, *INDEX_FILES))
_P7 = f"""
WITH {_LIVE},
tgt AS (
  SELECT upper(n.uuid) AS id, bool_or(c.deleted_at IS NULL) AS live, min(n.recorded_at) AS since
  FROM nodes n JOIN cur c ON upper(c.uuid) = upper(n.uuid) GROUP BY 1),
files AS (
  SELECT c.source_path AS path, t.live, t.since FROM cur c JOIN tgt t ON t.id = upper(c.uuid)
  WHERE c.node_label IN ({_LABELS}) AND c.source_path IS NOT NULL),
er AS (
  SELECT CAST(ref_id AS VARCHAR) AS k, recorded_at, source_path, regexp_replace(ref_source, '[#?].*$', '', 's') AS bare
  FROM extracted_refs WHERE is_local AND ref_id IS NOT NULL),
resolved AS (
  SELECT k, recorded_at,
    list_reduce(list_prepend('', string_split(
        CASE WHEN starts_with(bare, '/') THEN bare ELSE regexp_replace(source_path, '[^/]*$', '') || bare END, '/')),
      lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x IN ('', '.') THEN acc
                     ELSE acc || '/' || x END) AS p
  FROM er WHERE trim(bare) <> ''),
hits AS (
  SELECT r.k, r.recorded_at, f.live, f.since
  FROM (SELECT r.*, r.p || s.s AS cand FROM resolved r CROSS JOIN (VALUES {_SUFFIXES}) s(s)) r
  LEFT JOIN files f ON f.path = r.cand WHERE r.p IS NOT NULL),
rows_ AS (
  SELECT 'extracted_refs' AS t, k, recorded_at, bool_or(live IS NOT NULL) AS known, min(CASE WHEN live THEN since END) AS since
  FROM hits GROUP BY k, recorded_at
  UNION ALL
  SELECT 'nodes', l.id, l.recorded_at, t.id IS NOT NULL, CASE WHEN t.live THEN t.since END
  FROM live l LEFT JOIN tgt t ON t.id = l.pid WHERE l.pid IS NOT NULL
  UNION ALL
  SELECT 'batch_transitions', CAST(b.transition_id AS VARCHAR), b.recorded_at, t.id IS NOT NULL, CASE WHEN t.live THEN t.since END
  FROM batch_transitions b LEFT JOIN tgt t ON t.id = upper(b.uuid) WHERE trim(b.uuid) <> '' AND b.transition_id IS NOT NULL),
kinds AS (
  SELECT t, k, recorded_at, CASE WHEN NOT known THEN 'missing' WHEN since IS NULL THEN 'deleted'
         WHEN since > recorded_at THEN 'late' END AS kind FROM rows_),
orphans AS (
  SELECT t AS ref_table, k AS ref_key, min_by(kind, recorded_at) AS orphan_kind, strftime(min(recorded_at), '%Y-%m') AS ref_month
  FROM kinds WHERE kind IS NOT NULL GROUP BY t, k)
"""

SQL = {
    "p3_found": _P3,
    "p3_hierarchy": _P3_ALL,
    "p3_whole": _P3_WHOLE,
    "p3_descendants": _P3_PAIRS,
    "p4_found": _P4,
    "p7_found": _P7 + "SELECT * FROM orphans",
    "p7_report": _P7 + """SELECT ref_table, ref_month, orphan_kind, count(*) AS n_orphans FROM orphans
GROUP BY ref_table, ref_month, orphan_kind""",
}
