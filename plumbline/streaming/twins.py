"""Incremental twins of the batch aggregations, as Structured Streaming jobs.

Every stream ends in a table under the session's checkpoint folder. State is bounded by
watermarks, except the running totals, whose state is one row per key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.tables import upsert_last
from plumbline.session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, folder: str, name: str, per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder whose name matches, as they arrive."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def _home(spark: SparkSession, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{label}-{uuid.uuid4().hex[:12]}"


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Drain the stream into parquet in append mode and read the result."""
    spark = stream.sparkSession
    home = _home(spark, label)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start(f"{home}/table").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/table")


class VersionedTable:
    """A keep-last table without MERGE: every batch writes the next version and then counts.

    A batch that runs again finds its own version and leaves it as it is."""

    def __init__(self, spark: SparkSession, home: str, keys: list[str]):
        self.spark, self.home, self.keys, self.last = spark, home, keys, None

    def path(self, batch: int) -> str:
        return f"{self.home}/table/v{batch}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame | None:
        return None if self.last is None else self.spark.read.parquet(self.path(self.last))

    def put(self, rows: DataFrame, batch: int) -> None:
        if not self._exists(self.path(batch)):
            old = self.read()
            (rows if old is None else upsert_last(old, rows, self.keys)).write.mode("overwrite").parquet(self.path(batch))
        self.last = batch


def run_upsert(stream: DataFrame, keys: list[str], label: str, mode: str = "update", order: str | None = None) -> DataFrame:
    """Fold every micro-batch into a keep-last table."""
    from plumbline.operators.tables import one_per_key

    spark = stream.sparkSession
    home = _home(spark, label)
    table = VersionedTable(spark, home, keys)

    def sink(rows: DataFrame, batch: int) -> None:
        table.put(one_per_key(rows, keys, [order], last=True) if order else rows, batch)

    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return table.read() if table.last is not None else spark.createDataFrame([], stream.schema)


def running_totals(stream: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Paid claims and their sum per key, updated as pages arrive."""
    return stream.withColumn("_a", amount).filter(F.col("_a") > 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("claim_count"), F.sum("_a").alias("total_loss"))


def windowed_totals(stream: DataFrame, ts: str, keys: list[str], value: str, size: str = "3 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = F.window(ts, size, step)
    return stream.withWatermark(ts, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str, keys: list[str], value: str, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Episodes per unit: readings closer than the gap belong together."""
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n", "total")


def first_seen(stream: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Repeats of a key inside the watermark delay are dropped; state never outlives the delay."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
