"""Session defaults used by the tests, the bench and the driver entry."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(cpus: str = "8", app: str = "qassay") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage, from spark.checkpoint.dir. Only a session whose executors live in the driver's own
    process (master local[...]) may go without the setting; on a cluster its absence is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    folder = configured or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"qassay-{uuid.uuid4().hex}")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder
