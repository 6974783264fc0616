"""Every core query gives what its SQL gives in DuckDB, and those without SQL give rows."""

from __future__ import annotations

from importlib import import_module
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import difference
from weftgraph.session import scratch_scope

MODULES = [import_module(m) for m in entry.CORE_MODULES]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data_dir, name):
    assert difference(QUERIES[name](spark, data_dir), ORACLES[name], data_dir) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, data_dir, name):
    assert QUERIES[name](spark, data_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns


def test_empty_tables_are_no_error(spark, data_dir, tmp_path_factory):
    """Every core query on tables without rows ends; most give none."""
    d = str(tmp_path_factory.mktemp("empty"))
    for p in Path(data_dir).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).coalesce(1).write.parquet(f"{d}/{p.name}")
    with scratch_scope():
        failed = {}
        for name, query in QUERIES.items():
            try:
                query(spark, d).collect()
            except Exception as e:  # noqa: BLE001
                failed[name] = str(e)[:200]
    assert failed == {}
