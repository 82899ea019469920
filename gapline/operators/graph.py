"""Iterative graph steps that survive lost executors: state between rounds is a table in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One folder for all tables of this process, so that they go together.
RUN = f"gapline-{uuid.uuid4().hex}"
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_at_exit: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a session on one machine gets a temporary folder; on a cluster that is an error, since each executor
    would write to its own disk.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return os.path.join(tempfile.gettempdir(), "gapline-shared")
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession) -> str:
    """A path for a table of this run; the run's folder goes when the process ends."""
    run = f"{shared_dir(spark)}/{RUN}"
    if run not in _at_exit:
        _at_exit.add(run)

        def gone():
            with contextlib.suppress(Exception):  # the JVM may have ended first
                _delete(spark, run)

        atexit.register(gone)
    return f"{run}/{uuid.uuid4().hex}"


def written(spark: SparkSession, schema, path: str) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    _written[out] = path
    return out


def materialise(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputation.

    A plain Parquet table rather than ``checkpoint()``: columns stay pruned and statistics are known to the optimizer.
    Rows, columns and nulls are kept as they are; the order of rows is not. ``options`` go to the Parquet writer. The table
    stays until ``discard`` or the end of the process.
    """
    path = new_path(df.sparkSession)
    df.write.options(**options).parquet(path)
    return written(df.sparkSession, df.schema, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing unfinished reads any more; other DataFrames are left alone."""
    for t in tables:
        if path := _written.pop(t, None):
            _delete(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all tables of this process; results that were not written elsewhere can't be read afterwards."""
    _delete(spark, f"{shared_dir(spark)}/{RUN}")


def least_reachable(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``id`` and ``root`` (the smallest id reachable) for the ids of undirected ``edges`` (``a``, ``b``).

    Each round takes the smallest root among neighbours, then jumps to that root's root; it ends when nothing changes.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    step = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("root")))
    for _ in range(max_rounds):
        roots = step.select("id", "root")
        near = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        now = roots.join(near, "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("id").alias("root"), F.col("root").alias("far"))
        now = materialise(now.join(jump, "root", "left").select("id", "was", F.least("root", F.coalesce("far", "root")).alias("root")))
        settled = now.where("was <> root").isEmpty()
        discard(step)
        step = now
        if settled:
            discard(both)
            return step.select("id", "root")
    raise RuntimeError("labels did not settle")
