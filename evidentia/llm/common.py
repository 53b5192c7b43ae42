"""Shared pieces of the corpus operators: reading tables, cutting lineage, running sums."""

from __future__ import annotations

import atexit
import ctypes
import os
import sys
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.session import checkpoint_root

#: Runs of these characters count as one gap between words, here as in every operator.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The whole text; a null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that every executor reaches; removed when the driver ends."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps start from these files, so a lost executor costs no recomputation of what
    came before, and rows keep the identity they had when they were written.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over tasks by ``keys`` and write them so: later joins and cogroups by these keys find them in place.

    Adaptive planning does not tell a checkpoint how its rows are dealt, so this one job plans without it.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(parts, *keys).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # noqa: BLE001 - the session has ended before the driver
            return


atexit.register(_remove_written)


def give_back() -> None:
    """At the end of a task: memory that its worker no longer uses goes back to the system.

    Workers outlive their tasks and wait for the next stage, which runs beside them.
    """
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def single_threaded() -> None:
    """Inside a task: native libraries use the one core that the task owns."""
    for name in ("TOKENIZERS_PARALLELISM", "OMP_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "false" if name.startswith("TOK") else "1")
