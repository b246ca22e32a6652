"""The one session setting the library relies on, and sessions for tests."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Spark 4.1 may take a union of equally partitioned inputs for partitioned and, once exchanges below it
# are reused, still concatenate its inputs: windows and groups above such a union then see only parts of
# their keys. All other settings are left to the caller; results do not depend on them.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def tune(spark: SparkSession) -> SparkSession:
    """Switch off the optimization of unions that may lose rows of a key."""
    spark.conf.set(UNION_PARTITIONING, "false")
    return spark


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("planloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("PLANLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="planloom-")
    context.setCheckpointDir(named)
