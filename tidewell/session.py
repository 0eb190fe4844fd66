"""Sessions for local work, and the settings that a session given by a cluster may lack."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of an Arrow batch between Spark and Python.
BATCH = 2000
ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tidewell") -> SparkSession:
    """A session on this machine, with the settings that results depend on (UTC, ANSI as Spark has it)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEWELL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def attach(spark: SparkSession) -> SparkSession:
    """Let the Python workers of this session import the package from where the driver has it.

    On a cluster whose workers have the package installed this adds a path that doesn't exist there, which is harmless.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    # whole texts in batches of the default 10,000 rows take much memory on both sides; a smaller setting of the user's stays
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return spark
