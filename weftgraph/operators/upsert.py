"""Incremental upserts of parsed graphs: what changed, what is rewritten, what has to be embedded or summarised again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators.traverse import oriented, reachable

# Labels of nodes that carry structure, not content, and the stage that takes up a file in a state.
STRUCTURAL = ("File", "Directory", "Project")
STAGES = {
    "pending": "parse", "parsing": "parse", "parsed": "link", "linking": "link", "linked": "entities", "entities": "entities", "embedding": "embed",
}
#: Shorter texts are not embedded; texts that need no chunks are cut to so many characters.
LEAST_TEXT, MOST_TEXT = 5, 4_000


def create_nodes(nodes: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Nodes with new ones added, also columns that only these have; a new row with a blank key is an error when read."""
    checked = new.where(F.assert_true(F.coalesce(F.trim(F.col(key).cast("string")) != "", F.lit(False)), f"a row to create lacks {key}").isNull())
    return nodes.unionByName(checked, allowMissingColumns=True)


def file_changes(old: DataFrame, new: DataFrame, path: str = "path", digest: str = "hash", dirty: DataFrame | None = None) -> DataFrame:
    """``path, change``: new, modified, unchanged, deleted, or error for a file whose digest could not be made.

    ``dirty(path)``: files of which some node was written under an older schema; they count as modified.
    """
    o = old.select(F.col(path).alias("_op"), F.col(digest).alias("_od"))
    n = new.select(F.col(path).alias("_np"), F.col(digest).alias("_nd"))
    j = o.join(n, F.col("_op") == F.col("_np"), "full")
    if dirty is not None:
        j = j.join(dirty.select(F.col(path).alias("_dp"), F.lit(True).alias("_dirty")).distinct(), F.col("_np") == F.col("_dp"), "left")
    force = F.coalesce("_dirty", F.lit(False)) if dirty is not None else F.lit(False)
    change = (
        F.when(F.col("_np").isNull(), "deleted").when(F.col("_nd").isNull(), "error").when(F.col("_op").isNull(), "new")
        .when(~F.col("_od").eqNullSafe(F.col("_nd")) | force, "modified").otherwise("unchanged")
    )
    return j.select(F.coalesce("_np", "_op").alias(path), change.alias("change"))


def node_changes(stored: DataFrame, parsed: DataFrame, key: str = "uuid", digest: str = "hash", label: str = "label", dirty: str | None = None) -> DataFrame:
    """``key, change`` of content nodes: created, updated, unchanged, deleted. Structural nodes and those without digest
    are no content. A stored node whose ``dirty`` column is true is updated whatever its digest."""
    content = F.col(digest).isNotNull() & ~F.coalesce(F.col(label).isin(*STRUCTURAL), F.lit(False))
    force = F.coalesce(F.col(dirty), F.lit(False)) if dirty else F.lit(False)
    o = stored.where(content).select(F.col(key).alias("_ok"), F.col(digest).alias("_od"), force.alias("_force"))
    n = parsed.where(content).select(F.col(key).alias("_nk"), F.col(digest).alias("_nd"))
    change = (
        F.when(F.col("_ok").isNull(), "created").when(F.col("_nk").isNull(), "deleted")
        .when((F.col("_od") != F.col("_nd")) | F.col("_force"), "updated").otherwise("unchanged")
    )
    return o.join(n, F.col("_ok") == F.col("_nk"), "full").select(F.coalesce("_nk", "_ok").alias(key), change.alias("change"))


def upsert_graph(
    stored: DataFrame, edges: DataFrame, parsed: DataFrame, parsed_edges: DataFrame, *, key: str = "uuid", digest: str = "hash", label: str = "label", dirty: str | None = None
) -> dict[str, DataFrame]:
    """One incremental ingestion as new tables: ``nodes``, ``edges``, and ``stats`` (``change, n``), which alone is a dry run.

    Deleted nodes go with their edges, updated ones lose their outgoing edges, created, updated and all structural nodes
    are written as parsed, and of the parsed edges those that touch a written node are merged in. Edges have ``src, dst,
    type``. Each key is in each table once.
    """
    changes = node_changes(stored, parsed, key, digest, label, dirty)
    written = parsed.join(changes.where("change in ('created', 'updated')").select(F.col(key).alias("_c")), F.col(key) == F.col("_c"), "left")
    written = written.where(F.col("_c").isNotNull() | F.col(label).isin(*STRUCTURAL)).drop("_c")
    ids = written.select(F.col(key).alias("_w"))
    gone = changes.where("change = 'deleted'").select(F.col(key).alias("_g"))
    renewed = changes.where("change = 'updated'").select(F.col(key).alias("_u"))
    kept = stored.join(gone, F.col(key) == F.col("_g"), "left_anti").join(ids, F.col(key) == F.col("_w"), "left_anti")
    old = edges.join(gone, F.col("src") == F.col("_g"), "left_anti").join(gone, F.col("dst") == F.col("_g"), "left_anti")
    old = old.join(renewed, F.col("src") == F.col("_u"), "left_anti").select("src", "dst", "type")
    touching = parsed_edges.join(ids, F.col("src") == F.col("_w"), "left_semi").unionByName(parsed_edges.join(ids, F.col("dst") == F.col("_w"), "left_semi"))
    return {
        "nodes": kept.unionByName(written, allowMissingColumns=True),
        "edges": old.unionByName(touching.select("src", "dst", "type")).distinct(),
        "stats": changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")),
    }


def stored_hashes(nodes: DataFrame, wanted: DataFrame, by: str = "uuid", digest: str = "hash") -> DataFrame:
    """``by, digest`` of the stored nodes with a wanted id or path."""
    return nodes.join(wanted.select(F.col(by).alias("_w")), F.col(by) == F.col("_w"), "left_semi").where(F.col(digest).isNotNull()).select(by, digest)


def resumable(files: DataFrame, state: str = "node_state") -> DataFrame:
    """Files that a run left unfinished, with the ``stage`` that takes them up."""
    stage = F.lit(None).cast("string")
    for s, name in STAGES.items():
        stage = F.when(F.col(state) == s, name).otherwise(stage)
    return files.withColumn("stage", stage).where("stage is not null")


def capture_metadata(tables: Mapping[str, DataFrame], columns: Sequence[str], key: str = "uuid") -> DataFrame:
    """``label, key`` and the columns of all tables, null where a label lacks one; rows that hold none of them are left out."""
    out = None
    for name, df in tables.items():
        have = [c for c in columns if c in df.columns]
        if not have:
            continue
        part = df.where(F.coalesce(*(F.col(c).isNotNull() for c in have[:1])) if len(have) == 1 else F.greatest(*(F.col(c).isNotNull() for c in have)))
        part = part.select(F.lit(name).alias("label"), F.col(key).cast("string").alias(key), *have)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def restore_metadata(fresh: DataFrame, captured: DataFrame, provider: str, vectors: Sequence[str], key: str = "uuid", digest: str = "hash") -> DataFrame:
    """Fresh rows that take over captured vectors if the content is the same and the provider made them.

    ``captured`` has ``key, digest, provider`` and the vector columns; other rows keep what they have.
    """
    c = captured.select(F.col(key).alias("_k"), F.col(digest).alias("_d"), F.col("provider").alias("_p"), *(F.col(v).alias(f"_{v}") for v in vectors))
    same = (F.col("_p") == provider) & F.col("_d").eqNullSafe(F.col(digest))
    j = fresh.join(c, F.col(key) == F.col("_k"), "left")
    return j.select(*(F.when(same, F.coalesce(F.col(f"_{n}"), F.col(n))).otherwise(F.col(n)).alias(n) if n in vectors else F.col(n) for n in fresh.columns))


def store_summaries(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One summary per (id, strategy): the newer one by ``ts``; columns ``id, strategy, hash, summary, ts``."""
    cols = ["hash", "summary", "ts"]
    both = stored.select("id", "strategy", *cols).unionByName(new.select("id", "strategy", *cols))
    best = F.max_by(F.struct(*cols), F.struct("ts", "hash", "summary")).alias("m")
    return both.groupBy("id", "strategy").agg(best).select("id", "strategy", "m.*")


def cached_summaries(rows: DataFrame, stored: DataFrame, strategy: str, digest: str = "hash") -> DataFrame:
    """``id, summary`` of rows whose content is that of their stored summary."""
    s = stored.where(F.col("strategy") == strategy).select(F.col("id").alias("_i"), F.col("hash").alias("_h"), "summary")
    return rows.join(s, (F.col("id") == F.col("_i")) & (F.col(digest) == F.col("_h"))).select("id", "summary")


def summaries_due(rows: DataFrame, stored: DataFrame, threshold: int, strategy: str, digest: str = "hash", text: str = "text") -> DataFrame:
    """``id, reason``: large texts without a summary of the strategy (missing), or with one of other content (stale)."""
    s = stored.where(F.col("strategy") == strategy).select(F.col("id").alias("_i"), F.col("hash").alias("_h"), F.lit(True).alias("_has"))
    reason = F.when(F.col("_has").isNull(), "missing").when(~F.col("_h").eqNullSafe(F.col(digest)), "stale")
    return rows.where(F.length(text) > threshold).join(s, F.col("id") == F.col("_i"), "left").select("id", reason.alias("reason")).where("reason is not null")


def relationship_snippets(
    ids: DataFrame, edges: DataFrame, targets: DataFrame, name: str, *, direction: str = "outgoing", depth: int = 1, fields: Sequence[str] = ("signature", "name", "title"), limit: int = 10
) -> DataFrame:
    """``id, snippet``: a line per related node under the relationship's name, the first ``limit`` distinct ones by text.

    A node's line is the first of its fields that is not blank. Edges are reduced to those of ``ids(id)`` first, and the
    limit is applied before the shuffle as well, so a hub costs no more than its limit.
    """
    if depth > 1:
        pairs = reachable(ids.select("id").distinct(), edges.select("src", "dst"), depth, direction).where("depth > 0").select(F.col("root").alias("a"), F.col("node").alias("b"))
    else:
        pairs = oriented(edges, direction).join(ids.select(F.col("id").alias("_i")), F.col("a") == F.col("_i"), "left_semi")
    line = F.coalesce(*(F.when(F.length(F.trim(F.col(f))) > 0, F.col(f)) for f in fields if f in targets.columns))
    lines = pairs.join(targets.select(F.col("id").alias("_t"), line.alias("line")), F.col("b") == F.col("_t")).where("line is not null").select("a", "line").distinct()
    first = lines.withColumn("_r", F.row_number().over(W.partitionBy("a").orderBy("line"))).where(F.col("_r") <= limit)
    body = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return first.groupBy(F.col("a").alias("id")).agg(F.concat(F.lit(f"[{name}]\n"), body).alias("snippet"))


def embedding_texts(rows: DataFrame, source: str, include: Sequence[str] = (), snippets: Sequence[DataFrame] = (), steps: Sequence = (), id_col: str = "id") -> DataFrame:
    """``id, text``: source, further fields and snippets that are not blank, apart by blank lines, after the steps; rows
    with a blank source or result are left out."""
    filled = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    j = rows.where(F.length(F.trim(F.col(source))) > 0)
    parts = [F.col(source), *(filled(F.col(c)) for c in include)]
    for n, s in enumerate(snippets):
        j = j.join(s.select(F.col("id").alias(f"_i{n}"), F.col("snippet").alias(f"_s{n}")), F.col(id_col) == F.col(f"_i{n}"), "left")
        parts.append(F.col(f"_s{n}"))
    text = F.trim(X.preprocess(F.concat_ws("\n\n", *parts), steps))
    return j.select(F.col(id_col).alias("id"), text.alias("text")).where(F.length("text") > 0)


def embedding_tasks(rows: DataFrame, stored: DataFrame, provider: str, model: str) -> DataFrame:
    """``id, part, text, reason, start_line, end_line``: what has to be embedded.

    ``rows(id, text, hash, start_line)`` against ``stored(id, hash, provider, model)``: reason is missing, content,
    provider or model. Texts below ``LEAST_TEXT`` characters are left out, large ones come in chunks whose lines count
    from the row's first line, others whole but for ``MOST_TEXT`` characters (part 0).
    """
    s = stored.select(F.col("id").alias("_i"), F.col("hash").alias("_h"), F.col("provider").alias("_p"), F.col("model").alias("_m"))
    reason = (
        F.when(F.col("_i").isNull() | F.col("_h").isNull(), "missing").when(~F.col("_h").eqNullSafe(F.col("hash")), "content")
        .when(~F.col("_p").eqNullSafe(F.lit(provider)), "provider").when(~F.col("_m").eqNullSafe(F.lit(model)), "model")
    )
    due = rows.where(F.length(F.trim("text")) >= LEAST_TEXT).join(s, F.col("id") == F.col("_i"), "left").withColumn("reason", reason).where("reason is not null")
    due = due.select("id", "text", "reason", F.coalesce("start_line", F.lit(1)).cast("long").alias("_from"))
    large = due.where(X.needs_chunking(F.col("text")))
    cut = X.chunks(large.withColumn("_k", F.struct("id", "reason", "_from")), "_k", "text")
    at = lambda c: (F.col(c) + F.col("id._from") - 1).cast("long").alias(c)
    parts = cut.select("id.id", F.col("index").cast("int").alias("part"), "text", "id.reason", at("start_line"), at("end_line"))
    n = F.size(F.split("text", "\n", -1)).cast("long")
    whole = due.where(~X.needs_chunking(F.col("text"))).select(
        "id", F.lit(0).alias("part"), X.truncate(F.col("text"), MOST_TEXT).alias("text"), "reason", F.col("_from").alias("start_line"), (F.col("_from") + n - 1).alias("end_line")
    )
    return parts.unionByName(whole)


def stale_vectors(rows: DataFrame, state: str = "node_state") -> DataFrame:
    """Rows whose vectors do not stand for their content: any state but ready or embedded, none included."""
    return rows.where(~F.coalesce(F.col(state).isin("ready", "embedded"), F.lit(False)))


def change_records(changes: DataFrame, entity_type: Column, entity_id: Column, kind: Column, ts: Column, meta: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows of a change log: ``change_id, entity_type, entity_id, change_type, ts, metadata``; equal changes share their id."""
    m = F.to_json(F.struct(*(c.alias(n) for n, c in (meta or {}).items()))) if meta else F.lit("{}")
    digest = F.substring(F.sha2(F.concat_ws(":", entity_id.cast("string"), kind, F.unix_micros(ts.cast("timestamp")).cast("string")), 256), 1, 16)
    return changes.select(digest.alias("change_id"), entity_type.alias("entity_type"), entity_id.cast("string").alias("entity_id"), kind.alias("change_type"), ts.alias("ts"), m.alias("metadata"))
