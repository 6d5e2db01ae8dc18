"""Shared storage for stage tables.

Stage tables cut lineage: each is written once as Parquet in the folder named by
``spark.checkpoint.dir``, which driver and executors share, so a lost executor
costs only the tasks it was running.  Where that setting is unset and the master is
local (tests) a temporary folder of this process is used.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_LOCK, _WRITERS, _BEFORE = threading.Lock(), [], []
BATCH = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path without a trailing slash."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tallyspark-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold ``BATCH`` bytes at most, so that what
    a Python worker holds follows neither the number nor the length of texts.  A smaller
    limit stays as it is."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH).removesuffix("b")) <= BATCH:
        conf.set(_BATCH, BATCH)
    return df


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """While stage tables are written, shuffle files go as soon as their write ends.  The
    setting is the session's: writers that overlap share it, the last one restores it."""
    with _LOCK:
        if not _WRITERS:
            _BEFORE[:] = [spark.conf.get(_CLEAN, None)]
            spark.conf.set(_CLEAN, "true")
        _WRITERS.append(None)
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS.pop()
            if not _WRITERS:
                if _BEFORE[0] is None:
                    spark.conf.unset(_CLEAN)
                else:
                    spark.conf.set(_CLEAN, _BEFORE[0])


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and return it as read back, with its path."""
    spark, path = bounded(df).sparkSession, new_path(df.sparkSession, name)
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete stage tables that no returned DataFrame reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def files(uri: str):
    """The file system and path of a URI in the shared folder, for Python workers."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimate(df: DataFrame) -> int:
    """The planner's size estimate in bytes, 0 where it has none; runs nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size > 1 << 60 else size


def spread(df: DataFrame, part: int = 16 << 20) -> DataFrame:
    """A table too small for a scan task per core is dealt to all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    part = min(part, df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if 0 < estimate(df) < cores * part else df
