"""Spark session helpers shared by the library, tests and the bench."""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: one scratch folder per driver process, below the shared checkpoint directory
_RUN = uuid.uuid4().hex


def build_session(master: str | None = None, app: str = "tieout", shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the session the platform provides.

    AQE stays on: it coalesces the many small shuffle partitions produced by the
    name-level joins and splits skewed partitions when one client holds most rows.
    ``TIEOUT_CHECKPOINT_DIR`` names the checkpoint directory when the Spark
    configuration has none.
    """
    master = master or os.environ.get("TIEOUT_MASTER", "local[8]")
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.driver.memory", os.environ.get("TIEOUT_DRIVER_MEMORY", "16g"))
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if "TIEOUT_CHECKPOINT_DIR" in os.environ and not _checkpoint_dir(spark):
        spark.conf.set("spark.checkpoint.dir", os.environ["TIEOUT_CHECKPOINT_DIR"])
    return spark


def _checkpoint_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: below ``spark.checkpoint.dir``, else below the
    directory given to ``SparkContext.setCheckpointDir``. Without either there is no folder that
    all executors are known to share, so this raises instead of picking a machine-local one."""
    base = _checkpoint_dir(spark)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir (or call SparkContext.setCheckpointDir) to a folder all executors share")
    return f"{base.rstrip('/')}/tieout-{_RUN}"


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new path for one intermediate table or file set."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete one path through Hadoop's file system API (any store Spark reads)."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table this process wrote. Call it once the results that read
    them are written; later reads of those DataFrames fail."""
    delete_path(spark, shared_dir(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint dir and
    read it back: one job, the plan downstream starts from a scan (with real
    size statistics for AQE), and the data survives executor loss.

    ``localCheckpoint`` is never used: its blocks die with the executor.
    """
    path = scratch_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineages(*dfs: DataFrame) -> tuple[DataFrame, ...]:
    """:func:`cut_lineage` of tables that do not need each other, at the same time: the tasks of one fill the cores that
    the last tasks of another leave idle."""
    def own(df: DataFrame):  # wrapped once for each thread: every one gets its own copy of the local properties
        wrap = inheritable_thread_target(df.sparkSession)
        return cut_lineage if wrap is df.sparkSession else wrap(cut_lineage)  # the session itself where threads are not pinned

    with ThreadPoolExecutor(len(dfs)) as pool:
        jobs = [pool.submit(own(df), df) for df in dfs]
        return tuple(j.result() for j in jobs)
