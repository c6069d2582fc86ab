"""Intermediate tables below spark.checkpoint.dir, the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is absent, a session on one machine (as in tests) gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_session_folders: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the session's own folder below spark.checkpoint.dir, which is deleted when the session's JVM ends.

    The session's folder is made at once: Hadoop registers only folders that exist for deletion.
    """
    root = _shared_root(spark)
    key = (spark.sparkContext.applicationId, root)
    if key not in _session_folders:
        folder = f"{root}/session-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.mkdirs(path) or not fs.deleteOnExit(path):
            raise OSError(f"cannot make {folder}")
        _session_folders[key] = folder
    return f"{_session_folders[key]}/{name}-{uuid.uuid4().hex}"


def output_dir(spark: SparkSession, name: str) -> str:
    """A new folder name for what a job is run for, which stays: below spark.newslink.output.dir, else beside the sessions' folders."""
    root = spark.conf.get("spark.newslink.output.dir", None) or f"{_shared_root(spark)}/outputs"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_made: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end, but for those with keep=True."""
    _made.append([])
    try:
        yield
    finally:
        discard(*_made.pop())


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    if _made and not keep:
        _made[-1].append(stored)
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialized tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
