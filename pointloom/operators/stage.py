"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _local_base() -> str:
    """One temporary folder for a local process that names none."""
    return tempfile.mkdtemp(prefix="pointloom-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, as a URI.

    A setting without a scheme lies on the session's default file system. Where it is absent, a local session
    (as in tests) gets a temporary folder; on a cluster that is an error, since executors could not see it.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{_local_base()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """df, written to the shared folder once and read again: later reads do not compute it anew."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete shared tables that no later plan reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan refers to any more; otherwise they stay until the driver's memory is collected."""
    gc.collect()
    spark._jvm.System.gc()


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """df, written once to a new shared folder and read again.

    Later steps neither recompute it nor carry its plan, and a lost executor loses nothing.
    """
    return written(df, shared_dir(df.sparkSession, name))


def is_hot(groups: DataFrame, keys: list[str], size: str, hot_groups: int = 1000) -> Column | None:
    """Whether a row's keys have the hash of a group that holds more than 1 / hot_groups of all entries; None if there is no such group.

    `size` counts a group's entries, so there are at most hot_groups of them, whose hashes become constants of the plan.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hash_of = f"xxhash64({', '.join(f'`{k}`' for k in keys)})"
    hot = groups.filter(F.col(size) > max(1, total // hot_groups)).select(F.expr(hash_of)).collect()
    return F.expr(f"{hash_of} IN ({', '.join(f'{h}L' for (h,) in hot)})") if hot else None


def join_groups(entries: DataFrame, groups: DataFrame, keys: list[str], size: str, hot_groups: int = 1000) -> DataFrame:
    """entries joined with the one row of their group, however large a group is.

    The rows of hot groups (`is_hot`), about hot_groups at most, are broadcast; the rest is an ordinary join.
    """
    hot = is_hot(groups, keys, size, hot_groups)
    if hot is None:
        return entries.join(groups, keys)
    by_hot = entries.filter(hot).join(F.broadcast(groups.filter(hot)), keys)
    return by_hot.unionByName(entries.filter(~hot).join(groups.filter(~hot), keys))
