"""Session set-up shared by the entry points, the bench and the tests."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def local_session(cores: str = "8", shuffle_partitions: str = "8") -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evidentia")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
    fallback = tempfile.mkdtemp(prefix="evidentia-checkpoint-")
    context.setCheckpointDir(fallback)
    return fallback


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the driver ends."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def _remove_scratch() -> None:
    for spark, path in _scratch:
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # noqa: BLE001 - the session has ended before the driver
            return


atexit.register(_remove_scratch)
