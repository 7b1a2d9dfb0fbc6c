"""Cutting lineage in storage every executor can reach."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="clientela-")
        context.setCheckpointDir(folder)
    return folder


def session_folder(spark: SparkSession) -> str:
    """This session's own folder for intermediate tables, removed when the driver ends."""
    found = getattr(spark, "_clientela_folder", None)
    if found is None:
        found = spark._clientela_folder = f"{ensure_checkpoint_dir(spark)}/clientela-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, found)
    return found


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Compute once, as a table in the checkpoint folder.

    A lost executor then costs no recomputation, and later readers fetch only the columns they
    need and know the size. The table goes with the session.
    """
    path = f"{session_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
