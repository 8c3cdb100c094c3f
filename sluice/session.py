"""Session settings and the one way lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "sluice") -> SparkSession:
    """A session for tests and the bench; a cluster supplies its own."""
    parts = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for written intermediates.

    Without one, a session whose executors all run on this machine gets a private folder; on a cluster that would leave
    every executor with files of its own, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="sluice-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written rows.

    Used where a reduced table (a daily panel, a set of pairs) feeds several
    branches of one plan: the scan of the raw table then runs once, and a lost
    executor is repaired from files instead of by repeating that scan.  The
    folder is the one the cluster names; a private one is chosen only where
    nothing is configured.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
