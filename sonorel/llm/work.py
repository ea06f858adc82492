"""Shared scratch tables: intermediate results that outlive the executors that made them.

They go to the folder in ``spark.checkpoint.dir``. Only a session on one machine, as in tests,
may leave it unset: then a temporary folder of this machine serves; on a cluster it is an error.
``held`` keeps what is cheap to make again on the executors' disks, within its lineage.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from sonorel.shipping import ship

_made: dict[str, SparkSession] = {}
_local: list[str] = []
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="sonorel-"))
    return _local[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sonorel-{uuid.uuid4().hex[:12]}-{name}"
    _made[path] = spark
    return path


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows inside the block; the session's own setting comes back after it."""
    before = spark.conf.get(_RECORDS)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(_RECORDS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_RECORDS, before)


def stored(df: DataFrame, name: str, rows: int = 512) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage. Its Python steps get batches of ``rows`` rows."""
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    with arrow_rows(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def held(df: DataFrame) -> DataFrame:
    """Keep ``df`` on the executors' own disks: what a lost executor held is made again from the tables it came from."""
    return df.persist(StorageLevel.DISK_ONLY)


def discard(*frames: DataFrame) -> None:
    """Free stored or held tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path is None:
            df.unpersist()
        else:
            drop_path(path)


def drop_path(path: str) -> None:
    """Remove a scratch folder that nothing will read again."""
    drop(path, _made.pop(path))


def drop(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        try:
            drop(path, spark)
        except Exception:  # the JVM has gone: the folder's owner cleans up
            return
