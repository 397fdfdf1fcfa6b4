"""Intermediate tables of iterative operators, in storage that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Shuffle files of a finished write are of no more use: its rows are read from the table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Where the tables that stored() gave out are, as long as somebody holds them.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset on a single machine (a local master), a
    temporary folder that is then also set as checkpoint folder.

    On a cluster a temporary folder is each machine's own, so there the setting is required.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
        at = at and os.path.dirname(at)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it back: the lineage ends there, and a
    lost executor costs no recomputation.  The write's shuffle files go with it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def counted(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """stored(df, name), and aggregates over its rows that the write itself takes along."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(k) for k, c in figures.items()]), name)
    return out, seen.get


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables that stored() gave out and that nothing reads any more; frames of
    other origin, and None, are left alone."""
    for t in tables:
        path = _paths.pop(t, None) if t is not None else None
        if path:
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
