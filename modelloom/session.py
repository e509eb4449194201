"""Session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, checkpoint_dir: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters pass in their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("modelloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The folder named by ``spark.checkpoint.dir`` is the only one used on a cluster; its
    absence there is an error. A local session without one gets a folder in its warehouse.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    local = sc.master.startswith("local[") or sc.master == "local"
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured is None and not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


def shared_folder(spark: SparkSession) -> str:
    """A new folder for written tables, below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
