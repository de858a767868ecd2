"""Spark session defaults and the shared staging area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sessionlake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )


_own_folders: dict[str, str] = {}


class NoSharedFolder(RuntimeError):
    """A cluster names no folder that all its machines share."""


def staging_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster; one of our own only in local mode.

    The setting cannot be changed in a running session, so an own folder is kept
    per application. On a cluster every machine would write to its own disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise NoSharedFolder("spark.checkpoint.dir names no folder that executors share")
        application = spark.sparkContext.applicationId
        if application not in _own_folders:
            _own_folders[application] = tempfile.mkdtemp(prefix="sessionlake-")
        configured = _own_folders[application]
    return configured.rstrip("/")


def staging_folder(spark: SparkSession) -> str:
    """A new folder for the tables of one run; see ``remove_folder``."""
    return f"{staging_root(spark)}/sessionlake/{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove staged tables once nothing reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(frame: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``frame`` to the staging folder and read it back.

    A written table cuts the lineage, survives lost executors and, unlike a
    checkpointed RDD, keeps column pruning and filter pushdown for its readers.
    """
    spark = frame.sparkSession
    path = f"{folder or staging_folder(spark)}/{name}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
