"""Processing only new or changed records: a Merkle tree over key ranges, published together with the output.

A tree is a table ``level, node, n, d1, d2``: level counts bits, node is the first so many bits of the keys' hashes. A
node's digest is the combination of its children's, and of the rows' below it, so a deeper tree holds every shallower
one: two trees of different depth are compared on the levels that both have, and a growing table may deepen its tree.
"""

from __future__ import annotations

import os
import time
import uuid as _uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.ids import digest16, pack_uuid, unpack_uuid
from weftgraph.operators.versions import current_rows, version_order
from weftgraph.session import Scratch

FANOUT_BITS = 4
#: Levels that 64 bits of key hash can tell apart.
HASH_BITS = 60
#: Up to so many changed leaves are also sent to the scan of the saved rows as ranges, which prune row groups.
PUSHED_LEAVES = 512


def leaf_of(key: Column, bits: int) -> Column:
    """The key range of a key: the first ``bits`` of its hash, so ranges hold about equal numbers of any keys."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("bigint")


def tree_bits(n_rows: int, rows_per_leaf: int = 64) -> int:
    """A depth in whole levels that leaves about ``rows_per_leaf`` rows a leaf."""
    bits = max(1, (max(1, n_rows) // rows_per_leaf)).bit_length()
    return min(HASH_BITS, -(-bits // FANOUT_BITS) * FANOUT_BITS)


def _digests(n: Column, d1: Column, d2: Column) -> tuple[Column, ...]:
    return F.sum(n).alias("n"), F.bit_xor(d1).alias("d1"), F.bit_xor(d2).alias("d2")


def leaf_digests(rows: DataFrame, key: str, value: str, bits: int) -> DataFrame:
    """``leaf, n, d1, d2``: order-free digests of the (key, value) pairs of each leaf, aggregated on the map side.

    Two combinations of different hashes and the count, so equal digests of different contents need a coincidence of
    128 bits. A key that occurs twice with one value would cancel itself but for the count; keys occur once.
    """
    h1 = F.xxhash64(F.col(key), F.col(value), F.col(value).isNull())
    h2 = F.xxhash64(F.col(value).isNull(), F.col(value), F.lit(7), F.col(key))
    return rows.groupBy(leaf_of(F.col(key), bits).alias("leaf")).agg(*_digests(F.lit(1), h1, h2))


def merkle_tree(rows: DataFrame, key: str, value: str, bits: int) -> DataFrame:
    """``level, node, n, d1, d2`` of all levels from the root (0 bits) to the leaves; a leaf meets its ancestors in one
    aggregate whose size is that of the leaves times the levels. An empty table has an empty tree."""
    at = F.explode(F.sequence(F.lit(0), F.lit(bits), F.lit(FANOUT_BITS))).alias("level")
    leaves = leaf_digests(rows, key, value, bits).select("leaf", "n", "d1", "d2", at)
    node = F.expr(f"shiftrightunsigned(leaf, {bits} - level)").alias("node")
    return leaves.groupBy("level", node).agg(*_digests(F.col("n"), F.col("d1"), F.col("d2")))


def depth_of(tree: DataFrame) -> int | None:
    """The tree's deepest level; None if it is empty. Written trees are partitioned by level, so this reads no rows."""
    return tree.agg(F.max("level")).head()[0]


@dataclass
class Descent:
    """What a comparison found: ``leaves`` (``leaf``, of ``bits``), and per level how many of the nodes differ."""

    leaves: DataFrame
    bits: int
    differing: list[tuple[int, int]] = field(default_factory=list)


def descend(now: DataFrame, was: DataFrame, bits: int, scratch: Scratch) -> Descent:
    """Leaves that differ between two written trees, from the root down to ``bits``.

    A level is looked at only below the nodes that differ one level up. These are written once per level, so the plan
    of a level holds two scans and one comparison however deep it lies, and the descent ends where nothing differs.
    """
    found = Descent(None, bits)
    open_: DataFrame | None = None
    for level in range(0, bits + 1, FANOUT_BITS):
        sides = []
        for tree in (now, was):
            side = tree.where(F.col("level") == level)
            if open_ is not None:
                side = side.join(open_, F.shiftrightunsigned("node", FANOUT_BITS) == open_["leaf"], "left_semi")
            sides.append(side)
        a, b = (t.select("node", F.struct("n", "d1", "d2").alias(d)) for t, d in zip(sides, ("now", "was")))
        differ = a.join(b, "node", "full").where(~F.col("now").eqNullSafe(F.col("was")))
        open_ = scratch.write(differ.select(F.col("node").alias("leaf")), f"open-{level}")
        n = open_.count()
        found.leaves = open_
        found.differing.append((level, n))
        if not n:
            break
    return found


def row_changes(current: DataFrame, saved: DataFrame, key: str, value: str, found: Descent) -> DataFrame:
    """``key, value, change`` (new, changed or deleted; a deleted key has a null value), rows of changed leaves only.

    Both tables hold each key once; null values are contents of their own. A saved table that is sorted by ``h``, the
    hash of its key, as ``RunStore`` writes it, is read only in the row groups that overlap a changed leaf.
    """
    if not found.differing or not found.differing[-1][1]:
        none = current.limit(0)
        return none.select(key, value, F.lit("").alias("change"))
    at = leaf_of(F.col(key), found.bits)
    if "h" in saved.columns and found.differing[-1][1] <= PUSHED_LEAVES:
        width = 64 - found.bits
        leaves = sorted(r[0] for r in found.leaves.collect())  # at most PUSHED_LEAVES numbers
        signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        near = F.lit(False)
        for x in leaves:
            near = near | F.col("h").between(signed(x << width), signed((x << width) | ((1 << width) - 1)))
        saved = saved.where(near)
    leaves = found.leaves.select(F.col("leaf").alias("_changed"))
    now = current.withColumn("_leaf", at).join(leaves, F.col("_leaf") == F.col("_changed"), "left_semi")
    was = saved.withColumn("_leaf", at).join(leaves, F.col("_leaf") == F.col("_changed"), "left_semi")
    now = now.select(key, value, F.lit(True).alias("_now"))
    was = was.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.lit(True).alias("_was"))
    change = (
        F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(~F.col(value).eqNullSafe(F.col("_v")), "changed")
    )
    got = now.join(was, F.col(key).eqNullSafe(F.col("_k")), "full").withColumn("change", change).where("change is not null")
    return got.select(F.coalesce(key, "_k").alias(key), value, "change")


def changed_rows(current: DataFrame, saved: DataFrame, key: str, value: str, *, bits: int, scratch: Scratch) -> DataFrame:
    """``key, value`` of ``current`` whose value differs from the saved one or that have none, by trees made of both.

    Keys that are only in ``saved`` are not returned; ``row_changes`` reports them.
    """
    now = scratch.write(merkle_tree(current, key, value, bits), "tree-now", ["level"])
    was = scratch.write(merkle_tree(saved, key, value, bits), "tree-was", ["level"])
    got = row_changes(current, saved, key, value, descend(now, was, bits, scratch))
    return got.where("change <> 'deleted'").select(key, value)


def node_contents(nodes: DataFrame, runs: DataFrame, scratch: Scratch) -> DataFrame:
    """Per uuid: ``id, live, now`` (current content digest), ``done`` (content that a successful run completed)."""
    ok = runs.where(F.col("run_status") == "success").select(F.col("run_id").alias("_run")).distinct()
    rows = nodes.select("uuid", "content_hash", "node_state", "run_id", "deleted_at", "updated_at", "recorded_at").join(
        ok, F.col("run_id") == F.col("_run"), "left"
    )
    content = digest16(F.lower("content_hash"))
    complete = (
        F.col("_run").isNotNull() & F.col("node_state").isin("ready", "skip") & F.col("deleted_at").isNull()
    )
    best = F.max(F.when(complete, F.struct(version_order().alias("o"), content.alias("h")))).alias("_best")
    got = current_rows(rows, [content.alias("now"), F.col("deleted_at").isNull().alias("live")], [best])
    return scratch.write(got.select("id", "live", "now", F.col("_best.h").alias("done")), "contents")


def nodes_to_process(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """Live nodes whose current content no successful run has completed: ``uuid``.

    The completed contents are the saved state, the live nodes' contents the current one; the two Merkle trees tell
    which key ranges to compare. A node without content hash, or completed without one, has no completed content.
    """
    scratch = Scratch(nodes.sparkSession, "incremental")
    both = node_contents(nodes, runs, scratch)
    bits = tree_bits(both.count())
    now = both.where("live").select("id", F.col("now").alias("content"))
    was = both.where("done is not null").select("id", F.col("done").alias("content"))
    return changed_rows(now, was, "id", "content", bits=bits, scratch=scratch).select(unpack_uuid(F.col("id")).alias("uuid"))


class RunStore:
    """Versions below a folder, each of several tables (parts); a version exists once its marker does.

    ``publish`` writes all parts below a folder of its own and then puts a marker into place in one atomic step that
    fails if the marker exists: a hard link in a local folder, a rename without overwriting on HDFS and its like, a
    conditional write on object stores. A run that dies before leaves nothing that ``latest`` sees, and the next run
    repeats exactly its records; of two runs that publish after the same version one fails. ``vacuum`` removes what
    dead runs left behind.
    """

    OBJECT_STORES = ("s3a", "s3", "gs", "abfs", "abfss", "wasb", "wasbs", "oss")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def versions(self) -> list[int]:
        p = self._path(f"{self.root}/_published")
        if not self._fs.exists(p):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(p))
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self, part: str = "state") -> DataFrame | None:
        """A part of the last version; None if there is none or it lacks the part."""
        v = self.versions()
        if not v:
            return None
        path = f"{self._folder(v[-1])}/{part}"
        return self.spark.read.parquet(path) if self._fs.exists(self._path(path)) else None

    def _folder(self, version: int) -> str:
        stream = self._fs.open(self._path(f"{self.root}/_published/{version}"))
        try:
            return f"{self.root}/{stream.readUTF()}"
        finally:
            stream.close()

    def publish(self, output: DataFrame, state: DataFrame, after: int | None = None, **parts: DataFrame) -> int:
        """Writes output, state and further parts as the version after ``after`` (the last one, if not given)."""
        if after is None:
            after = (self.versions() or [0])[-1]
        name = f"run-{_uuid.uuid4().hex}"
        for part, df in {"output": output, "state": state, **parts}.items():
            by = ["level"] if part == "tree" else []
            df.write.partitionBy(*by).parquet(f"{self.root}/{name}/{part}")
        if not self._mark(after + 1, name):
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
            raise RuntimeError(f"version {after + 1} was published by another run")
        return after + 1

    def _write_name(self, path: str, name: str, overwrite: bool) -> None:
        out = self._fs.create(self._path(path), overwrite)
        out.writeUTF(name)
        out.close()

    def _mark(self, version: int, name: str) -> bool:
        """Puts the marker into place; False if another run's is there."""
        marker, made = f"{self.root}/_published/{version}", f"{self.root}/{name}/_marker"
        self._fs.mkdirs(self._path(f"{self.root}/_published"))
        scheme = self._fs.getUri().getScheme()
        if scheme in self.OBJECT_STORES:
            try:  # the object appears when the stream is closed, and only if there is none
                self._write_name(marker, name, False)
            except Exception:  # noqa: BLE001
                return False
            return self._folder(version) == f"{self.root}/{name}"
        self._write_name(made, name, True)
        if scheme == "file":
            local = lambda p: self._path(p).toUri().getPath()
            try:
                os.link(local(made), local(marker))
            except FileExistsError:
                return False
            return True
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(made), self._path(marker), options)
        except Exception:  # noqa: BLE001
            if self._fs.exists(self._path(marker)):
                return False
            raise
        return True

    def vacuum(self, keep: int = 2, older_than_s: float = 86_400) -> list[str]:
        """Removes folders of runs that no kept version names and that are old enough not to be running; their names."""
        kept = {self._folder(v).rsplit("/", 1)[1] for v in self.versions()[-keep:]}
        gone = []
        if not self._fs.exists(self._path(self.root)):
            return gone
        for s in self._fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            if name.startswith("run-") and name not in kept and time.time() - s.getModificationTime() / 1000 >= older_than_s:
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_published/{v}"), False)
        return gone


def run_incremental(source: DataFrame, key: str, value: str, store: RunStore, process: Callable[[DataFrame], DataFrame]) -> int:
    """One run: ``process`` gets the rows of ``source`` that are new or changed since the last published version.

    ``source`` holds each key once. The saved tree tells which key ranges of the saved (key, value) table to read. The
    rows that are processed are copied once, and the new state takes their values from that copy: what changes in
    ``source`` meanwhile is left to the next run, neither skipped nor repeated. Output, state (``k, v, h``, sorted by the
    key's hash), tree and the deleted keys (``k``) are published as one version, which is returned.
    """
    spark = source.sparkSession
    scratch = Scratch(spark, "run")
    after = (store.versions() or [0])[-1]
    pair = source.select(F.col(key).alias("k"), F.col(value).cast("string").alias("v"))
    now = scratch.write(pair, "now")
    state, tree = store.latest("state"), store.latest("tree")
    saved = state if state is not None else now.limit(0)
    old_bits = depth_of(tree) if tree is not None else None
    bits = tree_bits(now.count())
    own = scratch.write(merkle_tree(now, "k", "v", bits), "tree", ["level"])
    if tree is None or old_bits is None:
        tree, old_bits = own.limit(0), bits
    changes = scratch.write(row_changes(now, saved, "k", "v", descend(own, tree, min(bits, old_bits), scratch)), "changes")
    todo = changes.where("change <> 'deleted'").select(F.col("k").alias("_k"))
    rows = scratch.write(source.join(todo, F.col(key).eqNullSafe(F.col("_k")), "left_semi"), "rows")
    taken = rows.select(F.col(key).alias("k"), F.col(value).cast("string").alias("v"))
    drift = changes.where("change <> 'deleted'").select("k", "v").exceptAll(taken)
    calm = now.join(todo, F.col("k").eqNullSafe(F.col("_k")), "left_anti")
    if drift.head(1):
        # rows that vanished after they were first read keep their saved value, so their deletion is found next time
        lost = todo.join(taken, F.col("_k").eqNullSafe(F.col("k")), "left_anti")
        kept = saved.select("k", "v").join(lost, F.col("k").eqNullSafe(F.col("_k")), "left_semi")
        now = scratch.write(calm.unionByName(taken).unionByName(kept), "state")
        own = merkle_tree(now, "k", "v", bits)
    new_state = now.withColumn("h", F.xxhash64("k"))
    new_state = new_state.repartitionByRange("h").sortWithinPartitions("h")
    gone = changes.where("change = 'deleted'").select("k")
    return store.publish(process(rows), new_state, after, tree=own, deleted=gone)


__all__ = [
    "Descent", "RunStore", "changed_rows", "depth_of", "descend", "leaf_digests", "merkle_tree", "node_contents", "nodes_to_process", "pack_uuid",
    "row_changes", "run_incremental", "tree_bits",
]
