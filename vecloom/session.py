"""Where intermediate tables live, and how lineage is cut without losing fault tolerance."""

from __future__ import annotations

import atexit
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a table is a parquet file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only where that setting is absent (a local session, as in tests) is a temporary folder used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_local_dir()}"


_LOCAL: list[str] = []


def _local_dir() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="vecloom-"))
    return _LOCAL[0]


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system API, so any scheme works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        if path.startswith("file:"):
            import shutil

            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        else:
            delete_path(spark, path)
    except Exception:  # the session may already be gone at exit
        pass


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage: it survives the loss of any executor and is never computed twice. The
    folder is removed when the process ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vecloom_rows = _observed(counted)
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder whose content is removed when the process ends."""
    path = f"{shared_dir(spark)}/vecloom-{os.getpid()}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_quietly, spark, path)
    return path


def _observed(counted: Observation, seconds: float = 5.0) -> int | None:
    """The observed number of rows; None if the report of it does not arrive, as it does a moment after the job."""
    end = time.monotonic() + seconds
    future = counted._jo.future()
    while not future.isCompleted():
        if time.monotonic() > end:
            return None
        time.sleep(0.002)
    return counted.get["rows"]


def stored_rows(df: DataFrame) -> int | None:
    """How many rows a DataFrame of :func:`materialise` has; None for any other."""
    return getattr(df, "_vecloom_rows", None)
