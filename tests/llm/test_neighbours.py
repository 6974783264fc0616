from __future__ import annotations

import numpy as np
import pytest

from weftgraph.llm import neighbours as N

S = "uuid string, embedding array<float>, vec string, cls int"


def table(spark, rows):
    return spark.createDataFrame([(u, None if v is None else [float(x) for x in v], "clash", 1) for u, v in rows], S)


def brute(rows, dim, k):
    ok = {u: np.array(v, dtype=np.float32).astype(float) for u, v in rows if u is not None and v is not None and len(v) == dim and np.isfinite(np.array(v, dtype=float)).all() and any(v)}
    ids = sorted(ok)
    x = np.stack([ok[u] / np.linalg.norm(ok[u]) for u in ids]) if ids else np.empty((0, dim))
    out = set()
    for i, u in enumerate(ids):
        s = x @ x[i]
        best = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[j], 12), ids[j]))[:k]
        out |= {tuple(sorted((u, ids[j]))) for j in best}
    return out


def pairs(df, dim, k):
    return {tuple(r) for r in N.neighbour_pairs(df, dim, k).collect()}


def test_exact_on_one_part_with_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(f"u{i:03d}", rng.normal(size=8)) for i in range(80)]
    rows += [("z1", np.zeros(8)), ("z2", [float("nan")] * 8), ("z3", [float("inf")] + [1.0] * 7), ("z4", None), ("z5", [1.0]), (None, rng.normal(size=8)), rows[0], rows[1]]
    assert pairs(table(spark, rows), 8, 5) == brute(rows, 8, 5)


def test_a_third_of_all_vectors_equal(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=8)
    rows = [(f"h{i:03d}", v) for i in range(60)] + [(f"u{i:03d}", rng.normal(size=8)) for i in range(90)]
    assert pairs(table(spark, rows), 8, 5) == brute(rows, 8, 5)


def test_few_or_no_rows(spark):
    assert pairs(table(spark, []), 8, 5) == set()
    one = [("a", [1.0] * 8)]
    assert pairs(table(spark, one), 8, 5) == set()
    two = [*one, ("b", [2.0] * 8)]
    assert pairs(table(spark, two), 8, 5) == {("a", "b")}


def test_recall_with_many_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(f"u{i:05d}", centres[i % 40] + 0.5 * rng.normal(size=16)) for i in range(3000)]
    monkeypatch.setattr(N, "PART_ROWS", 250)
    monkeypatch.setattr(N, "BASE_BLOCK", 200)
    monkeypatch.setattr(N, "QUERY_BLOCK", 800)
    want, got = brute(rows, 16, 5), pairs(table(spark, rows), 16, 5)
    assert len(want & got) / len(want) >= 0.95
    x = N.unit(np.stack([v for _, v in rows]).astype(np.float32))
    r = N.fit_router(x, 12)
    assert r.probes < 12 and np.bincount(r.parts(x, 1)[:, 0], minlength=12).max() < 3000 * 0.35


@pytest.mark.parametrize("n_parts", [2, 5])
def test_parts_are_balanced(n_parts):
    rng = np.random.default_rng(4)
    x = N.unit(rng.normal(size=(400, 6)).astype(np.float32))
    part = N.balanced_parts(x, N.sample_graph(x, 5), n_parts, rng)
    assert np.bincount(part, minlength=n_parts).max() <= np.ceil(1.1 * 400 / n_parts)


def test_part_numbers():
    assert N.part_numbers(0, 0) == (1, 1) and N.part_numbers(999, 999) == (1, 1) and N.part_numbers(8_000, 8_000) == (4, 1)
    for n in (10**6, 10**8):  # as many parts as asked for, each learned from enough of a sample
        outer, inner = N.part_numbers(n, N.SAMPLE_ROWS)
        assert outer * inner * N.PART_ROWS >= n and max(outer, inner) <= -(-N.SAMPLE_ROWS // N.PART_SAMPLE) + 10


def test_recall_with_parts_cut_twice(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    rows = [(f"u{i:05d}", centres[i % 60] + 0.5 * rng.normal(size=16)) for i in range(4000)]
    monkeypatch.setattr(N, "PART_ROWS", 120)
    monkeypatch.setattr(N, "PART_SAMPLE", 100)
    monkeypatch.setattr(N, "SAMPLE_ROWS", 900)
    seen = []
    plain = N._fit_inner
    monkeypatch.setattr(N, "_fit_inner", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = {tuple(r) for r in N.similar_vectors(table(spark, rows), 16, 5, 900).select("uuid", "neighbour").collect()}
    assert len(seen) == 1 and len(seen[0]) > 3 and any(len(r.b2) > 1 for r in seen[0].values())
    x = np.stack([v / np.linalg.norm(v) for _, v in rows])
    s = x @ x.T
    np.fill_diagonal(s, -1)
    want = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in np.argsort(-s[i])[:5]}
    assert len(got) == len(want) and len(want & got) / len(want) >= 0.93
