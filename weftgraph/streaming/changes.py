"""Change feeds: coalescing, debounce, windows, deduplication, expiry, as streams and as their batch equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.segments import previous, running_sums, segmented


def coalesce_changes(events: DataFrame, key: str = "path", kind: str = "change_type", order: str = "seq") -> DataFrame:
    """One change per key of a batch: the last deletion if there is one, else the last update, else the first event."""
    k = F.col(kind)
    pick = F.max(F.struct(
        F.when(k == "deleted", 2).when(k == "updated", 1).otherwise(0).alias("p"),
        F.when(k.isin("deleted", "updated"), F.col(order)).otherwise(-F.col(order)).alias("o"),
        k.alias("k"), F.col(order).alias("at"),
    )).alias("m")
    return events.groupBy(key).agg(pick).select(key, F.col("m.k").alias(kind), F.col("m.at").alias(order))


def coalesced_stream(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1 second", **names: str):
    """A streaming query that hands each micro-batch's coalesced changes and its id to ``sink``, which must be idempotent by id."""
    return (
        events.writeStream.foreachBatch(lambda df, n: sink(coalesce_changes(df, **names), n))
        .option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
    )


def debounce(events: DataFrame, gap: str = "1 second", key: str = "path", ts: str = "ts") -> DataFrame:
    """Bursts per key: events closer than the gap form one (``key, start, end, n``). Works on streams with a watermark."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def net_changes(events: DataFrame, key: str = "path", kind: str = "change_type", order: str = "seq") -> DataFrame:
    """Pending work per key: an addition and a later removal in one batch cancel each other."""
    first, last = F.min_by(kind, order), F.max_by(kind, order)
    g = events.groupBy(key).agg(first.alias("_f"), last.alias(kind))
    return g.where(~((F.col("_f") == "created") & (F.col(kind) == "deleted"))).drop("_f")


def tumbling(events: DataFrame, size: str, ts: str = "ts", by: str = "event_type", late: str | None = None) -> DataFrame:
    df = events.withWatermark(ts, late) if late else events
    return df.groupBy(F.window(ts, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def sliding(events: DataFrame, size: str, slide: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    df = events.withWatermark(ts, late) if late else events
    return df.groupBy(F.window(ts, size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "n")


def unique_within(events: DataFrame, keys: list[str], late: str, ts: str = "ts") -> DataFrame:
    """A stream without repeats of the keys within the watermark; a batch without repeats at all."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def expired(rows: DataFrame, now, days: int, ts: str = "last_access", key: str = "path") -> DataFrame:
    """Keys whose latest access is older than the retention."""
    t = F.lit(now).cast("timestamp")
    return rows.groupBy(key).agg(F.max(ts).alias("last")).where(F.col("last") < t - F.expr(f"INTERVAL {days} DAYS"))


def gap_sessions(events: DataFrame, gap_seconds: int, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``key, session_no, start, end, n`` by gaps between neighbouring events, for finished tables."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = previous(segmented(events, [key], [ts, tie]), [key], [ts, tie], ts, "_before")
    new = F.coalesce(us(ts) - us("_before") > gap_seconds * 1_000_000, F.lit(True)).cast("int")
    s = running_sums(e.withColumn("_new", new), [key], [ts, tie], {"session_no": F.col("_new")})
    return s.groupBy(key, "session_no").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there, once, into a memory table: for tests and backfills of bounded size."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def watched(spark, root: str, known: DataFrame, path_glob: str = "*") -> DataFrame:
    """``path, change_type, seq`` of a folder against ``known(path, modified_at)``: what a watcher would have reported.

    A listing compared with the last one finds every addition, change and removal since then, however long nothing
    looked, and its repetition finds nothing; ``seq`` is the file's time of change.
    """
    now = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", path_glob).load(root).select(F.col("path").alias("_p"), F.col("modificationTime").alias("_t"))
    j = known.select("path", "modified_at").join(now, F.col("path") == F.col("_p"), "full")
    kind = F.when(F.col("path").isNull(), "created").when(F.col("_p").isNull(), "deleted").when(F.col("_t") != F.col("modified_at"), "updated")
    return j.select(F.coalesce("_p", "path").alias("path"), kind.alias("change_type"), F.unix_micros(F.coalesce("_t", "modified_at")).alias("seq")).where("change_type is not null")


def project_batches(events: DataFrame, sink: Callable[[str, DataFrame, int], None], checkpoint: str, project: str = "project_id", **names: str):
    """A streaming query that hands each micro-batch's coalesced changes to ``sink`` project by project, with the batch's id.

    The projects of a batch are few; their changes stay tables. All that is there is processed, then the query ends.
    """

    def run(df: DataFrame, n: int) -> None:
        df.persist()
        try:
            for r in df.select(project).where(F.col(project).isNotNull()).distinct().orderBy(project).collect():
                sink(r[0], coalesce_changes(df.where(F.col(project) == r[0]), **names), n)
        finally:
            df.unpersist()

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
