from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weftgraph.operators.hierarchy import all_descendants, descendants, full_hierarchy, live_nodes, misplaced_nodes, resolve_hierarchy
from weftgraph.session import Scratch

SCHEMA = "uuid string, parent_uuid string, node_name string, node_depth int, updated_at timestamp, recorded_at timestamp, deleted_at timestamp, pid string, root string"
T0 = dt.datetime(2025, 1, 1)


def uid(i):
    return f"{i:08X}-0000-0000-0000-000000000000"


def row(i, parent=None, depth=0, day=0, arrived=0, deleted=False, name=None):
    t = T0 + dt.timedelta(days=day)
    return (uid(i), parent if parent is None or isinstance(parent, str) else uid(parent), name or f"n{i}", depth, t, t + dt.timedelta(hours=arrived), t if deleted else None, "clash", "clash")


def nodes(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    cur = {}
    for r in rows:
        k = (r[4], -r[5].timestamp())
        if r[0] and (r[0].upper() not in cur or k > cur[r[0].upper()][0]):
            cur[r[0].upper()] = (k, r)
    live = {u: r for u, (_, r) in cur.items() if r[6] is None}
    out = {}
    for u in live:
        seen, at = [], u
        while at not in seen:
            seen.append(at)
            p = (live[at][1] or "").upper()
            if p not in live:
                break
            at = p
        else:
            out[u] = ("", -1)
            continue
        out[u] = (seen[-1], len(seen) - 1)
    return live, out


def found(df):
    return {(r["uuid"], r["root_uuid"], r["real_depth"]) for r in df.collect()}


def expected(rows):
    live, res = brute(rows)
    return {(u, *v) for u, v in res.items() if v[1] == -1 or live[u][3] is None or live[u][3] != v[1]}


def test_versions_deletions_cycles_and_loose_parents(spark):
    rows = [
        row(1), row(2, 1, 1), row(3, 2, 9), row(4, 3, None),
        row(5, 6, 1), row(6, 5, 1), row(7, 5, 2), row(8, 8, 0),  # a cycle, one below it, a loop
        row(9, 1, 1), row(9, 1, 1, day=1, deleted=True), row(10, 9, 0),  # a deleted parent counts as none
        row(11, 99, 0), row(12, "", 0), row(13, uid(1).lower(), 1),
        row(14, 1, 1, day=2), row(14, 2, 7, day=2, arrived=5), row(14, 3, 7, day=1),  # the earliest of equal versions
        (None, uid(1), "x", 0, T0, T0, None, "", ""), ("", uid(1), "x", 0, T0, T0, None, "", ""),
        ("odd id", uid(1), "x", 5, T0, T0, None, "", ""), row(15, "odd id", 2, name=None),
    ]
    assert found(misplaced_nodes(nodes(spark, rows))) == {x if x[0] != "odd id" else x for x in {(a.upper() if a == "odd id" else a, b, c) for a, b, c in expected(rows)}}


def test_empty(spark):
    assert misplaced_nodes(nodes(spark, [])).count() == 0
    assert full_hierarchy(nodes(spark, [])).count() == 0


def test_long_chain_and_hot_parent(spark):
    rows = [row(i, i - 1 if i else None, i) for i in range(70)] + [row(1000 + i, 69, 70 if i % 2 else 3) for i in range(300)]
    assert found(misplaced_nodes(nodes(spark, rows))) == expected(rows)


def test_paths_and_descendants(spark):
    df = nodes(spark, [row(1, name="a"), row(2, 1, 1, name="b"), row(3, 2, 2, name="c"), row(4, 4, 0)])
    got = {r["uuid"][:8]: (r["path"], r["real_depth"], r["n_descendants"]) for r in full_hierarchy(df).collect()}
    assert got == {"00000001": ("a", 0, 2), "00000002": ("a/b", 1, 1), "00000003": ("a/b/c", 2, 0), "00000004": (None, -1, 0)}
    s = Scratch(spark, "test")
    pairs = descendants(resolve_hierarchy(live_nodes(df), s, ancestors=True))
    assert sorted(r["distance"] for r in pairs.collect()) == [1, 1, 2]


def test_chains_and_pairs_of_live_nodes(spark):
    df = nodes(spark, [row(1), row(2, 1), row(3, 2), row(4, 4), row(5, 4), row(6, 1), row(6, 1, day=1, deleted=True), row(7, 6), row(8, 1)])
    chains = {r["uuid"]: r["ancestors"] for r in full_hierarchy(df).collect()}
    assert chains == {uid(1): [], uid(2): [uid(1)], uid(3): [uid(1), uid(2)], uid(4): None, uid(5): None, uid(7): [], uid(8): [uid(1)]}
    pairs = sorted(tuple(r) for r in all_descendants(df).collect())
    assert pairs == [(uid(1), uid(2), 1), (uid(1), uid(3), 2), (uid(1), uid(8), 1), (uid(2), uid(3), 1)]
    assert all_descendants(df.limit(0)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 14), st.one_of(st.none(), st.integers(0, 16)), st.one_of(st.none(), st.integers(0, 4)), st.integers(0, 2), st.booleans()), max_size=40))
def test_against_walking(spark, items):
    rows = [row(i, p, d, day, n, x) for n, (i, p, d, day, x) in enumerate(items)]
    assert found(misplaced_nodes(nodes(spark, rows))) == expected(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-1, 40), min_size=1, max_size=41))
def test_descendant_counts(spark, parents):
    rows = [row(i, None if p < 0 else p) for i, p in enumerate(parents)]
    live, res = brute(rows)
    want = dict.fromkeys(live, 0)
    for u in live:
        if res[u][1] >= 0:
            for _ in range(res[u][1]):
                u = live[u][1].upper()
                want[u] += 1
    got = {r["uuid"]: r["n_descendants"] for r in full_hierarchy(nodes(spark, rows), ancestors=False).collect()}
    assert got == want


def test_a_long_chain_takes_logarithmic_rounds(spark, monkeypatch):
    n, names = 300, []
    plain = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name="t", partition_by=(): names.append(name) or plain(self, df, name, partition_by))
    df = full_hierarchy(nodes(spark, [row(i, i - 1 if i else None) for i in range(n)]), ancestors=False)
    assert {(r["uuid"], r["n_descendants"]) for r in df.collect()} == {(uid(i), n - 1 - i) for i in range(n)}
    assert names.count("counts") <= 11 and names.count("round") <= 10
