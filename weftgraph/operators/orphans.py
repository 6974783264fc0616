"""References to records that are missing, deleted or arrived later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ids import digest16, pack_uuid, unpack_uuid
from weftgraph.operators.versions import current_rows
from weftgraph.session import Scratch

# Labels of nodes that stand for files, and what a reference may leave out of a target's path.
FILE_LABELS = ("File", "MarkdownDocument", "DataFile", "Stylesheet", "ImageFile")
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".css", ".scss", ".md", ".json", ".yaml")
INDEX_FILES = ("/index.ts", "/index.js")


def resolve_path(source_path: Column, ref: Column) -> Column:
    """``ref`` without anchor and query, resolved against the directory of ``source_path``; null if nothing is left.

    ``.`` and empty segments vanish, ``..`` removes the segment before it (at the top nothing). An absolute ``ref``
    stands alone.
    """
    bare = F.regexp_replace(ref, r"(?s)[#?].*$", "")
    folder = F.regexp_replace(source_path, r"[^/]*$", "")
    whole = F.when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(folder, bare))
    step = lambda acc, x: (
        F.when(x == "..", F.regexp_replace(acc, r"/[^/]*$", ""))
        .when((x == "") | (x == "."), acc)
        .otherwise(F.concat(acc, F.lit("/"), x))
    )
    return F.when(F.length(F.trim(bare)) > 0, F.aggregate(F.split(whole, "/", -1), F.lit(""), step))


def path_keys(path: Column) -> Column:
    """Every spelling under which a reference may mean the file: its path, without extension, without index file."""
    cut = lambda e: F.when(F.endswith(path, F.lit(e)), F.substring(path, F.lit(1), F.length(path) - len(e)))
    return F.array_compact(F.array(path, *(cut(e) for e in (*EXTENSIONS, *INDEX_FILES))))


def classify_references(references: DataFrame, targets: DataFrame) -> DataFrame:
    """Orphans among ``references(key, recorded_at, ...)`` against ``targets(key, live, since)``.

    Targets are first reduced to one validity row per key (map-side), then both streams are co-partitioned and sorted
    by key and merged once: ``missing`` without a row, ``deleted`` without a live one, ``late`` if the earliest live
    one came after the referring row. Keys must not be null. A hot key lies on the left side only, where AQE splits it.
    """
    interval = targets.groupBy("key").agg(F.min(F.when(F.col("live"), F.col("since"))).alias("since"), F.lit(True).alias("known"))
    kind = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("since").isNull(), "deleted")
        .when(F.col("since") > F.col("recorded_at"), "late")
    )
    merged = references.join(interval.hint("merge"), "key", "left")
    return merged.withColumn("orphan_kind", kind).where("orphan_kind is not null").drop("key", "since", "known")


def orphan_references(nodes: DataFrame, transitions: DataFrame, refs: DataFrame) -> DataFrame:
    """``ref_table, ref_key, orphan_kind, ref_month`` for the three tables that point at nodes.

    A redelivered reference counts once, with its earliest row. Rows with a null key column or a null or empty
    reference are no references; a row without ``recorded_at`` cannot be late and has a null month.
    """
    scratch = Scratch(nodes.sparkSession, "orphans")
    is_file = F.col("node_label").isin(*FILE_LABELS)
    per_node = scratch.write(
        current_rows(
            nodes,
            [
                F.col("deleted_at").isNull().alias("live"),
                pack_uuid(F.col("parent_uuid")).alias("pid"),
                F.when(is_file, F.col("source_path")).alias("file"),
                F.col("recorded_at").alias("seen"),
            ],
            [F.min("recorded_at").alias("since")],
        ),
        "per-node",
    )
    by_id = per_node.select(F.col("id").alias("key"), "live", "since")
    from_nodes = per_node.where("live and pid is not null").select(
        F.lit("nodes").alias("ref_table"), unpack_uuid(F.col("id")).alias("ref_key"), F.col("pid").alias("key"), F.col("seen").alias("recorded_at")
    )
    from_batches = transitions.where(F.col("transition_id").isNotNull()).select(
        F.lit("batch_transitions").alias("ref_table"),
        F.col("transition_id").cast("string").alias("ref_key"),
        pack_uuid(F.col("uuid")).alias("key"),
        "recorded_at",
    )
    by_path = per_node.where("file is not null").select(
        F.explode(path_keys(F.col("file"))).alias("spelling"), "live", "since"
    ).select(digest16(F.col("spelling")).alias("key"), "live", "since")
    from_files = refs.where(F.col("is_local") & F.col("ref_id").isNotNull()).select(
        F.lit("extracted_refs").alias("ref_table"),
        F.col("ref_id").cast("string").alias("ref_key"),
        digest16(resolve_path(F.col("source_path"), F.col("ref_source"))).alias("key"),
        "recorded_at",
    )
    found = classify_references(from_nodes.unionByName(from_batches).where("key is not null"), by_id).unionByName(
        classify_references(from_files.where("key is not null"), by_path)
    )
    first = F.min(F.struct(F.col("recorded_at").isNull().alias("n"), "recorded_at", "orphan_kind")).alias("f")
    return found.groupBy("ref_table", "ref_key").agg(first).select(
        "ref_table", "ref_key", F.col("f.orphan_kind").alias("orphan_kind"), F.date_format("f.recorded_at", "yyyy-MM").alias("ref_month")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, month and kind."""
    return orphans.groupBy("ref_table", "ref_month", "orphan_kind").agg(F.count(F.lit(1)).alias("n_orphans"))
