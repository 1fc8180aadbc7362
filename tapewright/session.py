"""Session helpers: recommended settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library is tuned for. A cluster sets its own master, memory and
# parallelism; these only switch on run-time re-planning and fix the time zone.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the Python call site of every column costs seconds on wide plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tapewright")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Rounds to whole powers keep small local jobs from planning idle tasks.
        .config("spark.sql.files.openCostInBytes", str(1 << 20))
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by every executor.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests, one machine) is a temporary folder made, and it is then remembered in
    the session so that one session uses one folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context_dir = spark.sparkContext.getCheckpointDir()
    if context_dir:
        return context_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, empty path under the work root."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
