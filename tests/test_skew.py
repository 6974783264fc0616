"""Joins keep whole results and split hot keys."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.entities import similar_vectors_in_type
from weftgraph.operators.hierarchy import resolve_hierarchy
from weftgraph.operators.ranges import containing_ranges
from weftgraph.operators.segments import previous, running_sums, segmented
from weftgraph.operators.strings import similar_between, similar_pairs
from weftgraph.operators.traverse import nearest_edges
from weftgraph.session import Scratch


def test_hot_parent_is_split(spark):
    """With thresholds lowered to the test's size, AQE splits the partition of a parent that holds most nodes."""
    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "6",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        pack = lambda c: F.unhex(F.md5(c.cast("string")))
        n = 60_000
        ids = spark.range(n).repartition(8).select(pack(F.col("id")).alias("id"), F.when(F.col("id") == 0, None).when(F.col("id") < 20_000, pack(F.floor(F.col("id") / 8))).otherwise(pack(F.lit(7))).alias("pid"))
        r = resolve_hierarchy(ids, Scratch(spark, "skew"))
        assert r.agg(F.count(F.lit(1)), F.count_distinct("root")).head()[:] == (n, 1)
        df = r.select("id", "root", "real_depth")
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_running_figures_of_a_hot_group(spark):
    """A group that holds most rows is spread over segments; figures equal those of a plain window."""
    df = spark.range(5_000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.xxhash64("id").alias("place"), (F.col("id") % 7).alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 1, 2), (None, 2, None)], df.schema))
    w = W.partitionBy("k").orderBy("place")
    want = {(r["k"], r["place"]): (r["s"], r["p"]) for r in df.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0))).withColumn("p", F.lag("v").over(w)).collect()}
    got = running_sums(df, ["k"], ["place"], {"s": F.col("v")}, parts=9)
    assert {(r["k"], r["place"]): r["s"] for r in got.collect()} == {k: v[0] for k, v in want.items()}
    assert {(r["k"], r["place"]): r["p"] for r in previous(df, ["k"], ["place"], "v", "p", parts=9).collect()} == {k: v[1] for k, v in want.items()}
    assert segmented(df, ["k"], ["place"], 9).where("k = 'hot'").select("_seg").distinct().count() > 4
    assert running_sums(df.limit(0), ["k"], ["place"], {"s": F.col("v")}).count() == 0


def test_ranges_of_a_hot_group(spark):
    r = random.Random(2)
    ranges = [(i, "hot" if i % 3 else "b", s := r.randint(-50, 400), s + r.choice([-1, 0, 1, 3, 40, 300])) for i in range(150)] + [(900, None, 1, 2), (901, "hot", None, 4)]
    points = [(i, "hot" if i % 4 else "b", r.randint(-60, 500)) for i in range(300)] + [(900, None, 1), (901, "hot", None)]
    got = containing_ranges(spark.createDataFrame(points, "p int, g string, at int"), spark.createDataFrame(ranges, "i int, g string, s int, e int"), "g", "at", "s", "e")
    want = {(p, i) for p, g, at in points for i, h, s, e in ranges if g == h and g and None not in (at, s) and s <= at <= e}
    rows = [(x["p"], x["i"]) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize("threshold", [0.6, 0.7, 0.85])
def test_similar_texts_against_all_pairs(spark, threshold):
    r = random.Random(3)
    base = ["".join(r.choices("abcd_", k=r.randint(1, 14))) for _ in range(25)]
    texts = {b for b in base}
    for b in base:
        for _ in range(6):
            t = list(b)
            for _ in range(r.randint(1, 4)):
                k = r.randrange(len(t) + 1)
                t[k : k + r.randint(0, 1)] = r.choices("abcd_", k=r.randint(0, 1))
            texts.add("".join(t))
    rows = [(i, t, "x" if i % 2 else "y") for i, t in enumerate(sorted(texts))] + [(9000, None, "x"), (9001, "abc", None)]
    df = spark.createDataFrame(rows, "id int, name string, type string")
    good = [x for x in rows if x[1] and x[2]]

    def close(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            p, d[0] = d[0], i + 1
            for j, y in enumerate(b):
                p, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, p + (x != y))
        return 1 - d[-1] / max(len(a), len(b)) >= threshold

    want = {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[2] == b[2] and close(a[1], b[1])}
    got = [(x["a"], x["b"]) for x in similar_pairs(df, threshold, text_col="name", block=F.col("type")).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 5
    left, right = df.where("id % 3 = 0").select("id", "name"), df.where("id % 3 <> 0").select("id", "name")
    both = similar_between(left, right, threshold, left_id="id", left_text="name", right_id="id", right_text="name")
    texts = {x[0]: x[1] for x in rows if x[1]}
    assert {(x["l"], x["r"]) for x in both.collect()} == {(a, b) for a in texts for b in texts if a % 3 == 0 and b % 3 and close(texts[a], texts[b])}


@pytest.mark.parametrize("pivots", [1, 7])
def test_similar_vectors_against_all_pairs(spark, pivots):
    r = random.Random(4)
    rows = []
    for c in range(12):
        centre = [r.gauss(0, 1) for _ in range(6)]
        rows += [(c * 10 + i, "hot" if c % 3 else "b", [x + r.gauss(0, 0.15) for x in centre]) for i in range(10)]
    rows += [(500, "hot", [0.0] * 6), (501, "hot", None), (502, "hot", [1.0]), (504, "hot", [2.0]), (503, None, [1.0] * 6)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    ok = [x for x in rows if x[0] < 500]
    want = {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[1] == b[1] and cos(a[2], b[2]) >= 0.9} | {(502, 504)}
    got = [(x["a"], x["b"]) for x in similar_vectors_in_type(spark.createDataFrame(rows, "id long, type string, vec array<double>"), 0.9, pivots).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 50


def test_a_hub_is_limited_to_its_frontier(spark):
    """The edges of other nodes are gone before edges are made distinct or ranked."""
    edges = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("src"), (F.col("id") + 1).alias("dst"), F.lit("T").alias("type"))
    got = nearest_edges(spark.createDataFrame([(0,)], "node long"), edges, 15)
    assert got.where("dir = 'out'").count() == 15 and {r["b"] for r in got.where("dir = 'out'").collect()} <= set(range(60))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("WindowGroupLimit" if "WindowGroupLimit" in plan else "Window") < plan.index("LeftSemi")
