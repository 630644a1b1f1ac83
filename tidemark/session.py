"""Session settings, shared storage and table access."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(master: str = "local[8]", partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def ship_package(spark: SparkSession) -> None:
    """Python workers import this package: on one machine from where the driver has it, on a cluster from a copy that Spark sends, once a session."""
    if not is_local(spark) and not getattr(spark.sparkContext, "_has_tidemark", False):
        own = tempfile.mkdtemp(prefix="tidemark-")  # the driver serves the copy from here to all executors
        spark.sparkContext.addPyFile(shutil.make_archive(f"{own}/tidemark", "zip", ROOT, "tidemark"))
        spark.sparkContext._has_tidemark = True
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where it is unset and the master is local, a folder of our own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not is_local(spark) and context._jsc.sc().getCheckpointDir().isEmpty():
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A broadcast hint, given only after counting that df has at most max_rows rows; else df joins by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
