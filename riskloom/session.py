"""Spark session helpers: local test sessions and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "riskloom") -> SparkSession:
    """Session for tests and the local bench; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RISKLOOM_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared (DFS) folder and is used as is. Where it is
    unset, a scratch folder is made in local mode, where all tasks share one machine;
    elsewhere that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master or ""):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="riskloom-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables/models."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/riskloom-{name}-{uuid.uuid4().hex[:12]}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal the narrow rows of a CPU-heavy stage by a key over the shuffle partitions, whatever
    the number of files or partitions they come from."""
    return df.repartition(*columns)


#: Tasks that a stage has at least where each brings much along, and rows that a task of it takes.
FEW_TASKS, TASK_ROWS = 8, 1_000_000


def few_tasks(spark: SparkSession, rows: int) -> int:
    """Partitions for a stage whose tasks each hold or bring something as large as a model, so that
    every task more costs as much again: one a core, more only where a task's rows would be too
    many, and never more than the shuffle partitions asked for."""
    asked = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(asked, max(FEW_TASKS, spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def kept_folder(spark: SparkSession) -> str:
    """The shared folder for tables that outlive a session: beside the checkpoints, whose own
    folder Spark makes anew for each application."""
    own = ensure_checkpoint_dir(spark).rstrip("/")
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or own.rsplit("/", 1)[0]
    return f"{base.rstrip('/')}/riskloom-kept"
