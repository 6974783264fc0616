"""Session factory and scratch tables that cut lineage.

Scratch tables are Parquet files below the folder named by ``spark.checkpoint.dir``, which all executors share,
so losing an executor loses no intermediate result.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_LIVE: list[Scratch] = []


def build_session(app: str = "weftgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library counts on: UTC, AQE with skew joins, Arrow transfer."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where a session on one machine names none (tests).

    A session on several machines must name it: a folder of one machine is lost with it and not seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="weftgraph-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return "file://" + _OWN_DIR[0]


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``data_dir``."""
    return spark.read.parquet(os.path.join(data_dir, f"{name}.parquet"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Scratch:
    """Written intermediate tables of one operator call.

    ``write`` stores a DataFrame and returns it read back; ``drop`` removes a superseded table. What a lazy result
    still reads stays until the ``scratch_scope`` around the call ends, or else until the Python driver exits.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftgraph/{label}-{uuid.uuid4().hex}"
        self._n = 0
        if not _LIVE:  # after the gateway's own exit handler was registered, so the JVM still runs when this one is called
            atexit.unregister(_forget_all)
            atexit.register(_forget_all)
        _LIVE.append(self)

    def write(self, df: DataFrame, name: str = "t", partition_by: Sequence[str] = ()) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        # zstd: half the bytes of snappy on ids and digests, and these files count as working disk
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _forget(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may be gone already; a local folder can still be removed
            shutil.rmtree(self.root.removeprefix("file://"), ignore_errors=True)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Removes at its end the scratch tables that operators wrote inside; their results must have been used by then."""
    began = len(_LIVE)
    try:
        yield
    finally:
        for s in _LIVE[began:]:
            s._forget()  # noqa: SLF001
        del _LIVE[began:]


def _forget_all() -> None:
    for s in _LIVE:
        s._forget()  # noqa: SLF001
