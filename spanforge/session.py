"""Session defaults shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "spanforge") -> SparkSession:
    """A local session with the settings every result in this repository assumes (UTC above all)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPANFORGE_DRIVER_MEMORY", "12g"))
        .config("spark.checkpoint.dir", os.environ.get("SPANFORGE_CHECKPOINTS") or tempfile.mkdtemp(prefix="spanforge-checkpoints-"))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of parquet tables; Spark's reader only, so any store works."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path, below the session's checkpoint folder, which all machines share; without file: if it is one of a mounted file system."""
    checkpoint_folder(spark)
    below = spark.sparkContext.getCheckpointDir()
    return os.path.join(re.sub("^file:/*", "/", below), f"{name}-{uuid.uuid4().hex}")


def checkpoint_folder(spark: SparkSession) -> None:
    """Makes sure that the session names a folder for checkpoints.

    A session that names none gets a folder of this machine if it runs on this machine alone; on a cluster that is an error,
    as a folder of one machine goes with it.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanforge-checkpoints-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the folder that the session names in spark.checkpoint.dir, and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
