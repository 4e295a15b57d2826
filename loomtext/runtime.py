"""Session helpers shared by every operator: scratch storage, shipping code to Python workers, tables that cut lineage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of an Arrow batch that goes to a Python worker, at most, but for its last row.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_fallback: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: its parent folder joins the workers' PYTHONPATH.

    On a cluster whose machines do not hold the repository, submit the package with ``--py-files`` instead. Batches are
    cut at BATCH_BYTES unless the session names a limit of its own, as 10,000 long texts do not fit in a worker.
    """
    if spark.sparkContext.getConf().get(_BATCH) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])


def trim() -> None:
    """Give a worker's freed memory back to the system, Arrow's and, where it can, the C library's."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="loomtext-")
        spark.sparkContext.setCheckpointDir(_fallback[app])
    return _fallback[app]


_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{scratch_root(spark)}/loomtext/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch_paths():
    """A list of the scratch paths that are made within, so that they can be dropped once nothing reads them."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system API, so that any store works."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """Shuffle files of queries that run within are dropped as each ends, as nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame) -> DataFrame:
    """df on the executors' disks, for tables that are used more than once and soon dropped by unpersist(). Lineage stays:
    what a lost executor held is computed again, so its inputs must outlive it."""
    return df.persist(StorageLevel.DISK_ONLY)
