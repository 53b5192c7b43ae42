"""Exact dedup by stateful streaming.

A stream of documents updates keyed state on disk (RocksDB): per digest of the normalised
text the smallest identifier seen so far, the place its content lies at (file and row) and
how many rows had the digest. The state never expires. Every row whose digest was hit more
than once then has its full bytes compared; equal digests of different bytes part again.

The state is a built-in streaming aggregation, so rows of one digest are combined in each
task before the shuffle: a text that a third of all rows share reaches its state as one row
per task. Only rows with a hit keep their text beyond the join with the state.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import SPACE, shared_folder, stored, text_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Every part of the state is a database of its own with some MB of fixed files, and their number
#: stays as it was at the first start. So it follows the documents, not the shuffle partitions.
STATE_PARTS = "spark.sql.streaming.internal.stateStore.partitions"
ROWS_PER_PART = 2_000_000


def normalised(text: Column) -> Column:
    """White space runs become one space; nothing else changes."""
    return F.regexp_replace(text_of(text), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _place() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _first(key: str) -> Column:
    """Orders rows by identifier (a null one last), then by place, so exactly one is first."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("place"))


def state_after(
    spark: SparkSession, path: str, key: str = "doc_id", text: str = "text",
    digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Run the stream over all files of ``path``; returns the state: (digest, first, n).

    ``folder`` keeps state and offsets: called again with the same one, only files that came
    since are read. ``files_per_batch`` sizes the micro-batches.
    """
    folder = folder or shared_folder(spark, "dedup-state")
    # A pattern instead of a plain path: a table may be one file or a folder of files.
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    rows = rows.select(F.col(key), _place().alias("place"), digest(normalised(F.col(text))).alias("digest"))
    state = rows.groupBy("digest").agg(F.min(_first(key)).alias("first"), F.count(F.lit(1)).alias("n"))

    def keep_changes(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    held = spark.read.parquet(path).count() // ROWS_PER_PART
    parts = max(spark.sparkContext.defaultParallelism, held + 1)
    with _conf(spark, STATE_CONF | {STATE_PARTS: str(parts)}):
        writer = state.writeStream.outputMode("update").foreachBatch(keep_changes)
        running = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        running.awaitTermination()
    changes = spark.read.schema(state.schema.add("batch", "integer")).parquet(f"{folder}/changes")
    latest = changes.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("last"))
    return latest.select("digest", "last.first", "last.n")


def deduplicate(
    spark: SparkSession, path: str, key: str = "doc_id", text: str = "text",
    digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None,
) -> DataFrame:
    """One row per row of ``path``: key, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts equal each other. A null identifier comes after
    all others. Of rows that repeat the same identifier and text exactly one is kept. Very long
    texts are read whole. An empty table gives an empty result. Other columns are not read.
    """
    if not spark.read.parquet(path).take(1):
        nothing = spark.read.parquet(path).select(F.col(key), F.col(key).alias("keep_id"))
        return nothing.select(
            "*", F.lit(0).cast("bigint").alias("group_size"), F.lit(True).alias("kept"),
            F.lit("").alias("text_sha256"),
        ).limit(0)
    hit = F.col("n") > 1
    state = state_after(spark, path, key, text, digest, files_per_batch)
    again = state.where(hit).withColumnRenamed("digest", "__digest").hint("shuffle_hash")
    rows = spark.read.parquet(path).select(
        F.col(key), _place().alias("place"), normalised(F.col(text)).alias("body")
    ).withColumn("digest", digest(F.col("body")))
    rows = rows.join(again, rows.digest == again["__digest"], "left")
    rows = stored(
        rows.select(
            key, "place", "digest", F.sha2("body", 256).alias("text_sha256"), "first", "n",
            F.when(hit, F.col("body")).alias("body"),
        ),
        "dedup-hits",
    )
    # Full bytes of the hits: copies collapse in each task, so a group of any size sends few rows.
    texts = rows.where(hit).groupBy("digest", "body").agg(
        F.min(_first(key)).alias("own_first"), F.count(F.lit(1)).alias("own_n")
    )
    several = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    if several.take(1):
        parted = texts.join(several.select("digest"), "digest", "left_semi")
        rows = rows.join(parted, ["digest", "body"], "left")
        rows = rows.withColumns({"first": F.coalesce("own_first", "first"), "n": F.coalesce("own_n", "n")})
    return rows.select(
        key,
        F.when(F.col("n").isNull(), F.col(key)).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("n").isNull() | (F.col("first.place") == F.col("place"))).alias("kept"),
        "text_sha256",
    )
