"""Incremental maintenance of results over file streams (an extension: batch operators kept up to date).

Every stream here ends when the files that exist are read (availableNow) and can be started again from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.runtime import checkpoint_dir


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex[:12]}"


def file_stream(spark: SparkSession, path: str, *, files_per_batch: int = 8) -> DataFrame:
    """A stream over a parquet file or folder, with the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path if not path.endswith(".parquet") else path + "*")


def windowed_counts(spark: SparkSession, events: DataFrame, *, late: str = "2 hours", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``began, event_type, n, total`` of finished and open windows, kept by a watermark and written in update mode; the last update of a window counts."""
    out, state = _folder(spark, "windows"), _folder(spark, "windows-state")
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").cast("timestamp_ntz").alias("began"), "event_type", "n", "total", F.lit(number).alias("batch")).write.mode("append").parquet(out)

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("began", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("m")).select("began", "event_type", "m.n", "m.total")


def first_deliveries(spark: SparkSession, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each key's first arrival, by stateful deduplication; later deliveries are dropped."""
    out, state = _folder(spark, "first"), _folder(spark, "first-state")
    rows.select(key, *columns).dropDuplicates([key]).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
