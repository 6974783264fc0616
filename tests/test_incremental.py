from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.incremental import RunStore, changed_rows, depth_of, descend, merkle_tree, nodes_to_process, row_changes, run_incremental, tree_bits
from weftgraph.session import Scratch

T0 = dt.datetime(2025, 1, 1)


def test_changed_rows_against_sets(spark):
    r = random.Random(1)
    now = {f"k{i}": r.choice(["a", "b", None]) for i in range(3000)}
    was = {k: (v if r.random() < 0.95 else "old") for k, v in now.items() if r.random() < 0.97} | {"gone": "x"}
    frame = lambda d: spark.createDataFrame(list(d.items()), "k string, v string")
    for bits in (4, 8, 12):
        got = {x["k"] for x in changed_rows(frame(now), frame(was), "k", "v", bits=bits, scratch=Scratch(spark, "t")).collect()}
        assert got == {k for k, v in now.items() if k not in was or was[k] != v}


def test_empty_sides(spark):
    e = spark.createDataFrame([], "k string, v string")
    one = spark.createDataFrame([("a", "1")], "k string, v string")
    s = Scratch(spark, "t")
    assert changed_rows(e, e, "k", "v", bits=4, scratch=s).count() == 0
    assert changed_rows(one, e, "k", "v", bits=4, scratch=s).count() == 1
    assert changed_rows(e, one, "k", "v", bits=4, scratch=s).count() == 0


def test_tree_depth_follows_the_rows():
    assert [tree_bits(n) for n in (0, 1, 10_000)] == [4, 4, 8] and tree_bits(10**15) == 44


def test_trees_of_different_depth_agree(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("v"))
    get = lambda b: {(r["level"], r["node"]): tuple(r)[2:] for r in merkle_tree(rows, "k", "v", b).collect()}
    deep, flat = get(12), get(4)
    assert flat == {k: v for k, v in deep.items() if k[0] <= 4} and deep[(0, 0)][0] == 5000
    assert depth_of(merkle_tree(rows, "k", "v", 8)) == 8 and depth_of(merkle_tree(rows.limit(0), "k", "v", 8)) is None


def test_a_descent_looks_below_differing_nodes_only(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.lit("a").alias("v"))
    other = rows.withColumn("v", F.when(F.col("k") == "77", "b").otherwise(F.col("v")))
    s = Scratch(spark, "t")
    now, was = (s.write(merkle_tree(x, "k", "v", 12), "tree", ["level"]) for x in (other, rows))
    found = descend(now, was, 12, s)
    assert found.differing == [(0, 1), (4, 1), (8, 1), (12, 1)]
    changes = row_changes(other, rows, "k", "v", found)
    assert [tuple(r) for r in changes.collect()] == [("77", "b", "changed")]
    # the plan of a level reads two trees and the open nodes, however deep the level lies
    assert descend(now, now, 12, s).differing == [(0, 0)]


def test_plans_grow_by_a_constant_per_level(spark, monkeypatch):
    joins = []
    plain = Scratch.write

    def counted(self, df, name="t", partition_by=()):
        if name.startswith("open-"):
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return plain(self, df, name, partition_by)

    monkeypatch.setattr(Scratch, "write", counted)
    a = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.lit("a").alias("v"))
    changed_rows(a, a.withColumn("v", F.lit("b")), "k", "v", bits=16, scratch=Scratch(spark, "t")).count()
    assert joins == [1, 3, 3, 3, 3]


def node(u, h, state="ready", run=1, day=0, arrived=0, deleted=False):
    t = T0 + dt.timedelta(days=day)
    return (u, h, state, run, t if deleted else None, t, t + dt.timedelta(hours=arrived), "clash")


SCHEMA = "uuid string, content_hash string, node_state string, run_id long, deleted_at timestamp, updated_at timestamp, recorded_at timestamp, content string"


def test_nodes_to_process(spark):
    runs = spark.createDataFrame([(1, "success"), (2, "failed"), (3, None), (1, "success"), (None, "success")], "run_id long, run_status string")
    rows = [
        node("A", "h1"),  # done
        node("B", "h1"), node("B", "h2", "pending", None, 1),  # changed since
        node("C", "h1", "ready", 2), node("D", "h1", "ready", 3), node("E", "h1", "ready", None),  # never completed
        node("F", "H1"), node("F", "h1", "pending", 2, 1),  # only the letter case differs
        node("G", "h1"), node("G", "h1", day=1, deleted=True),  # deleted
        node("H", "h1", "error"), node("I", "h1", "skip"), node("J", None), node("K", "h1"), node("K", "h2", day=1), node("K", "h1", "pending", None, 2),
        node(None, "h1"), node("", "h1"),
    ]
    got = {r["uuid"] for r in nodes_to_process(spark.createDataFrame(rows, SCHEMA), runs).collect()}
    assert got == {"B", "C", "D", "E", "H", "J", "K"}
    assert nodes_to_process(spark.createDataFrame([], SCHEMA), runs).count() == 0


def test_runs_skip_and_repeat_nothing(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/state")
    src = lambda d: spark.createDataFrame(list(d.items()), "id string, body string")
    seen = []

    def process(df):
        seen.append({r["id"] for r in df.collect()})
        return df

    run_incremental(src({"a": "1", "b": "2", "n": None}), "id", "body", store, process)
    run_incremental(src({"a": "1", "b": "3", "c": "4", "n": None}), "id", "body", store, process)
    assert seen == [{"a", "b", "n"}, {"b", "c"}]

    def broken(df):
        return df.withColumn("body", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception):
        run_incremental(src({"a": "9", "c": "4"}), "id", "body", store, broken)
    assert store.versions() == [1, 2]
    run_incremental(src({"a": "9", "c": "4"}), "id", "body", store, process)
    assert seen[-1] == {"a"} and {r["id"] for r in store.latest("output").collect()} == {"a"}
    assert {r["k"] for r in store.latest("deleted").collect()} == {"b", "n"}


def test_the_saved_tree_and_few_of_the_saved_rows_are_read(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s")
    rows = spark.range(30_000).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("body"))
    run_incremental(rows, "id", "body", store, lambda df: df)
    tree, state = store.latest("tree"), store.latest("state")
    assert depth_of(tree) == 12 and tree.where("level = 0").head()["n"] == 30_000
    s = Scratch(spark, "t")
    other = rows.withColumn("body", F.when(F.col("id") == "5", "y").otherwise(F.col("body"))).select(F.col("id").alias("k"), F.col("body").alias("v"))
    found = descend(s.write(merkle_tree(other, "k", "v", 12), "tree", ["level"]), tree, 12, s)
    changes = row_changes(other, state, "k", "v", found)
    assert [r["k"] for r in changes.collect()] == ["5"]
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(h" in plan and "LessThanOrEqual(h" in plan
    # a deeper tree than the saved one is compared on the levels of both
    grown = rows.unionByName(spark.range(30_000, 300_000).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("body")))
    seen = []
    run_incremental(grown, "id", "body", store, lambda df: seen.append(df.count()) or df)
    assert seen == [270_000] and depth_of(store.latest("tree")) == 16


def test_a_run_that_dies_before_its_marker_is_repeated(spark, tmp_path, monkeypatch):
    store = RunStore(spark, f"file://{tmp_path}/s")
    src = lambda d: spark.createDataFrame(list(d.items()), "id string, body string")
    seen = []
    process = lambda df: seen.append({r["id"] for r in df.collect()}) or df
    run_incremental(src({"a": "1"}), "id", "body", store, process)
    for step in ("_mark", "_write_name"):
        with monkeypatch.context() as m:
            m.setattr(RunStore, step, lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                run_incremental(src({"a": "2", "b": "1"}), "id", "body", store, process)
        assert store.versions() == [1] and [r["v"] for r in store.latest().collect()] == ["1"]
    run_incremental(src({"a": "2", "b": "1"}), "id", "body", store, process)
    assert seen == [{"a"}] + [{"a", "b"}] * 3 and store.versions() == [1, 2]
    assert len(store.vacuum(keep=1, older_than_s=0)) == 3 and store.versions() == [2] and store.latest().count() == 2


def test_one_of_two_publishers_wins(spark, tmp_path):
    a, b = (RunStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    one = spark.createDataFrame([("a", "1")], "k string, v string")
    assert a.publish(one, one, 0) == 1
    with pytest.raises(RuntimeError):
        b.publish(one, one, 0)
    assert a.versions() == [1] and a.vacuum(older_than_s=0) == []


def test_what_changes_during_a_run_is_left_to_the_next(spark, tmp_path, monkeypatch):
    store = RunStore(spark, f"file://{tmp_path}/s")
    path = f"{tmp_path}/src"
    save = lambda d: spark.createDataFrame(list(d.items()), "id string, body string").write.mode("overwrite").parquet(path)
    plain = Scratch.write
    state = {"a": "1", "b": "1", "c": "1"}

    def moving(self, df, name="t", partition_by=()):
        if name == "rows":
            # between the two reads of the source: a changes again, b appears to have changed, c vanishes
            save({"a": "9", "b": "2"})
            spark.catalog.refreshByPath(path)
            df = spark.read.parquet(path).join(changed[0], ["id"], "left_semi")
        out = plain(self, df, name, partition_by)
        if name == "changes":
            changed[:] = [out.where("change <> 'deleted'").select(F.col("k").alias("id"))]
        return out

    changed = []
    save(state)
    run_incremental(spark.read.parquet(path), "id", "body", store, lambda df: df)
    save({"a": "2", "b": "1", "c": "2"})
    with monkeypatch.context() as m:
        m.setattr(Scratch, "write", moving)
        run_incremental(spark.read.parquet(path), "id", "body", store, lambda df: df)
    assert {(r["id"], r["body"]) for r in store.latest("output").collect()} == {("a", "9")}
    assert {(r["k"], r["v"]) for r in store.latest().collect()} == {("a", "9"), ("b", "1"), ("c", "1")}
    run_incremental(spark.read.parquet(path), "id", "body", store, lambda df: df)
    assert {(r["id"], r["body"]) for r in store.latest("output").collect()} == {("b", "2")}
    assert {r["k"] for r in store.latest("deleted").collect()} == {"c"}
