"""Settings every plan in this package relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of `df`: lineage is cut and a lost executor loses nothing.

    The folder is the one the cluster names in `spark.checkpoint.dir`; only a
    session on one machine gets a folder of its own without it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def checkpoint_partitioned(df: DataFrame) -> DataFrame:
    """Checkpoint that keeps the hash partitioning and order `df` ends with.

    Spark remembers both only for a plan that is fixed before it runs, so adaptive
    execution is off for this one job. Later windows and groupings on the same keys
    then need no shuffle and no sort.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpoint(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, for files a plan writes on the way."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="restitch-")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pin_file_splits(spark: SparkSession) -> None:
    """Keep file splits the same for every scan of this session.

    Spark derives the split size from the number of cores registered when a scan
    is planned. Executors may come and go between two scans of one script, and the
    line positions of both must agree, so the number is fixed at its first value.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


@contextmanager
def listed_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """Spark lists a long list of paths with a task for each; here a task takes many."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@lru_cache(maxsize=1)
def file_system_entry(spark: SparkSession) -> tuple[Any, Any]:
    """The class of paths and the settings of file systems, asked for once: each name on the way is a call to the JVM."""
    return spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder once; what follows reads the columns it needs."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
