from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from weftgraph import session


def test_the_folder_comes_from_the_session(spark):
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: {"spark.checkpoint.dir": "hdfs://h/shared/"}.get(key, default)))
    assert session.shared_dir(named) == "hdfs://h/shared"
    several = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="spark://h:7077"))
    with pytest.raises(RuntimeError):
        session.shared_dir(several)
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir", session.shared_dir(spark))


def test_scratch_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda s: f"file://{tmp_path}/shared")
    s = session.Scratch(spark, "x")
    df = s.write(spark.range(5).withColumn("a", F.array("id")), "t")
    assert df.count() == 5 and list(Path(tmp_path, "shared", "weftgraph").glob("x-*/001-t/*.parquet"))
    s.drop(df)
    assert not list(Path(tmp_path, "shared", "weftgraph").glob("x-*/001-t"))


def test_a_scope_removes_its_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda s: f"file://{tmp_path}/shared")
    before = session.Scratch(spark, "before")
    kept = before.write(spark.range(2))
    with session.scratch_scope():
        assert session.Scratch(spark, "inside").write(spark.range(3)).count() == 3
    assert kept.count() == 2 and not list(Path(tmp_path, "shared", "weftgraph").glob("inside-*"))
