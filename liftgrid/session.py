"""Session helpers: a local session for tests, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster use the session spark-submit provides."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("liftgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Where none is set, a session on one machine gets a private folder; any other is refused,
    because its executors would write to folders that the rest cannot see.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder; the master is {sc.master}")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="liftgrid-checkpoint-"))
        current = sc.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the copy.

    For frames that feed several jobs and are costly or risky to recompute; the copy
    outlives lost executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Cache a frame that feeds several actions; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
