"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "trendloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` as the cluster names it.

    Only in local mode (tests, a laptop), and where that is unset, a temporary folder is made and
    removed at exit. On a cluster such a folder would be another one on each machine: an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="trendloom-")
        atexit.register(shutil.rmtree, named, True)
        named = "file://" + os.path.abspath(named)
        spark.sparkContext.setCheckpointDir(named)
    return named


_SETTLED: list[str] = []


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts lineage and lets several plans read one result; the table survives the loss
    of any executor, and parquet keeps it small and lets later scans prune columns. It is
    written at once, while the plan that reads it is made, and is deleted by `release`, or at
    the end of the application.
    """
    spark = df.sparkSession
    path = scratch(spark, f"settled/{label}")
    _SETTLED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def release(spark: SparkSession) -> int:
    """Delete all tables that `settle` has written so far, once no plan needs them any more; how many there were."""
    n = len(_SETTLED)
    while _SETTLED:
        fs, at = _file_system(spark, _SETTLED.pop())
        fs.delete(at, True)
    return n


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores.

    For work that costs far more than moving its rows, where few files or row groups would leave
    cores idle. Where the scan has partitions enough, nothing is shuffled; a plan that shuffles
    already is left as it is (to ask it for its partitions would run it).
    """
    if "Adaptive" in df._jdf.queryExecution().executedPlan().nodeName():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
