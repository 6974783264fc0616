from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.orphans import orphan_references, orphan_report, path_keys, resolve_path

T = lambda d: dt.datetime(2025, 1, 1) + dt.timedelta(days=d)
N = "uuid string, node_label string, source_path string, parent_uuid string, deleted_at timestamp, updated_at timestamp, recorded_at timestamp, key string"
B = "transition_id long, uuid string, recorded_at timestamp, key string"
X = "ref_id long, source_path string, ref_source string, is_local boolean, recorded_at timestamp"


@pytest.mark.parametrize("src,ref,expected", [
    ("/a/b/c.ts", "./d", "/a/b/d"), ("/a/b/c.ts", "../d.css#x", "/a/d.css"), ("/a/b/c.ts", ".//e/./f?v=1", "/a/b/e/f"), ("/a/b.ts", "../../../x", "/x"),
    ("/a/b.ts", "/z/y", "/z/y"), ("/a/b.ts", "#top", None), ("/a/b.ts", "", None), ("/a/b.ts", None, None), ("/a/b/c.md", "x/../y.md?raw", "/a/b/y.md"),
])
def test_paths(spark, src, ref, expected):
    df = spark.createDataFrame([(src, ref)], "s string, r string")
    assert df.select(resolve_path(F.col("s"), F.col("r"))).head()[0] == expected


def test_spellings(spark):
    df = spark.createDataFrame([("/a/index.ts",)], "p string")
    assert df.select(path_keys(F.col("p"))).head()[0] == ["/a/index.ts", "/a/index", "/a"]


def test_kinds(spark):
    n = [
        ("A", "File", "/a/x.ts", None, None, T(0), T(1), "k"), ("B", "File", "/a/y.ts", "A", T(5), T(5), T(5), "k"),
        ("C", "Scope", "/a/x.ts", "B", None, T(1), T(1), "k"), ("D", "Scope", "/a/x.ts", "gone", None, T(1), T(2), "k"),
        ("E", "Scope", "/a/x.ts", "L", None, T(1), T(2), "k"), ("L", "File", "/a/late.ts", "", None, T(9), T(9), "k"),
        ("F", "Scope", "/a/x.ts", "a", None, T(1), T(1), "k"), (None, "File", "/q", None, None, T(1), T(1), "k"),
    ]
    b = [(1, "a", T(3), "k"), (1, "a", T(9), "k"), (2, "zz", T(3), "k"), (2, "zz", T(40), "k"), (3, None, T(3), "k"), (4, "", T(3), "k"), (5, "B", T(3), "k"), (None, "zz", T(3), "k"), (6, "L", T(3), "k"), (6, "L", T(20), "k")]
    x = [(1, "/a/q.ts", "./x", True, T(3)), (2, "/a/q.ts", "./nothing", True, T(3)), (3, "/a/q.ts", "./y", True, T(8)), (4, "/a/q.ts", "./late", True, T(3)),
         (5, "/a/q.ts", "./nothing", False, T(3)), (6, "/a/q.ts", "#here", True, T(3)), (7, "/a/q.ts", None, True, T(3)), (8, None, "./x", True, T(3)), (9, "/a/q.ts", "./x", None, T(3))]
    got = orphan_references(spark.createDataFrame(n, N), spark.createDataFrame(b, B), spark.createDataFrame(x, X))
    assert {tuple(r) for r in got.collect()} == {
        ("nodes", "C", "deleted", "2025-01"), ("nodes", "D", "missing", "2025-01"), ("nodes", "E", "late", "2025-01"),
        ("batch_transitions", "2", "missing", "2025-01"), ("batch_transitions", "5", "deleted", "2025-01"), ("batch_transitions", "6", "late", "2025-01"),
        ("extracted_refs", "2", "missing", "2025-01"), ("extracted_refs", "3", "deleted", "2025-01"), ("extracted_refs", "4", "late", "2025-01"),
    }
    assert sum(r["n_orphans"] for r in orphan_report(got).collect()) == 9
    e = lambda s: spark.createDataFrame([], s)
    assert orphan_references(e(N), e(B), e(X)).count() == 0
    assert orphan_references(e(N), spark.createDataFrame(b, B), e(X)).count() == 4
