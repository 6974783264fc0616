from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm.mixing import mixture, sainte_lague, shares_reached, token_counts

M = "mix_name string, source_name string, target_share double, max_repeats int, size_ratio double"


def plain(weights, seats):
    got = [0] * len(weights)
    if not any(w > 0 for w in weights):
        return got
    for _ in range(seats):
        i = max((i for i, w in enumerate(weights) if w > 0), key=lambda i: (Fraction(weights[i]) / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=8), st.integers(0, 60))
def test_highest_quotients(weights, seats):
    assert sorted(sainte_lague(weights, seats)) == sorted(plain(weights, seats)) and sum(sainte_lague(weights, seats)) in (0, seats)


def test_many_seats_cost_no_more():
    assert sum(sainte_lague([0.2, 0.3, 0.5], 10**12)) == 10**12


def docs(spark, n=600):
    return spark.createDataFrame([(i, f"word{i} " * (3 + i % 17), ("a", "b", "c")[0 if i % 3 else 1 + i % 2], "clash") for i in range(n)], "doc_id long, text string, source string, shard string")


def test_shares_and_repeats(spark):
    d = docs(spark)
    m = spark.createDataFrame([("m", "a", 1.0, 1, 0.5), ("m", "b", 2.0, 3, 0.5), ("m", "c", 1.0, None, 0.5), ("m", "none", 0.0, 4, 0.5), ("m", "Unknown", 0.0, 4, 0.5), ("z", "a", 0.0, 2, 1.0), (None, "a", 1.0, 1, 1.0)], M)
    total = sum(r["n_tokens"] for r in token_counts(d).collect())
    for shard_rows in (50_000, 40):
        got = mixture(d, m, block_tokens=64, shard_rows=shard_rows).collect()
        assert max(Counter((r["mix_name"], r["doc_id"]) for r in got).values()) == 1
        limit = {"a": 1, "b": 3, "c": 1}
        assert all(1 <= r["times"] <= limit[r["source_name"]] for r in got) and {r["mix_name"] for r in got} == {"m"}
        size = defaultdict(int)
        for r in got:
            size[r["source_name"]] += r["times"] * r["n_tokens"]
        assert abs(size["a"] - total * 0.5 * 0.25) < 0.02 * total and abs(size["b"] - total * 0.5 * 0.5) < 0.02 * total
    again = {tuple(r) for r in mixture(d, m, block_tokens=64, shard_rows=40).collect()}
    assert again == {tuple(r) for r in got}
    rep = {(r["mix_name"], r["source_name"]): r for r in shares_reached(mixture(d, m), m).collect()}
    assert abs(rep["m", "a"]["target_share"] - 0.25) < 1e-9 and rep["m", "Unknown"]["n_tokens"] == 0


def test_dirty_rows(spark):
    rows = [(1, None, "a", ""), (2, "", "a", ""), (3, "x y", None, ""), (None, "x", "a", ""), (4, "p " * 5000, "a", ""), (4, "p " * 5000, "a", "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    assert {(r["doc_id"], r["n_tokens"] > 0) for r in token_counts(d).collect()} == {(1, False), (2, False), (4, True)}
    m = spark.createDataFrame([("m", "a", 1.0, 2, 2.0)], M)
    assert {(r["doc_id"], r["times"]) for r in mixture(d, m).collect()} == {(1, 2), (2, 2), (4, 2)}
    assert mixture(d.limit(0), m).count() == 0 and mixture(d, m.limit(0)).count() == 0
