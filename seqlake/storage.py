"""Shared scratch storage: cut lineage by a written table, never by executor-local blocks."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_scratch() -> str:
    return tempfile.mkdtemp(prefix="seqlake-")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a folder of our own, but only if all tasks run in this machine's JVM."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: the master is {master}")
        base = "file://" + _own_scratch()
    return f"{base.rstrip('/')}/seqlake-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to shared storage and read it back with its schema."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems: the one place that needs the JVM, as Spark has no call for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by materialize() that nothing reads any more; others are left alone.

    Shuffle files of the jobs that wrote and read them go too: Spark's cleaner removes them once the driver's JVM has
    collected their plans, which by itself it may not do for half an hour.
    """
    gone = None
    for t in tables:
        path = t.__dict__.pop("_scratch_path", None) if t is not None else None
        if path:
            gone = t.sparkSession
            delete(gone, path)
    if gone is not None:
        gone._jvm.System.gc()
