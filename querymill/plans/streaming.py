"""Streams over the data directory, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.session import ship
from querymill.streaming import incremental as I


def event_windows(spark, d):
    ship(spark)
    return I.windowed_counts(spark, I.file_stream(spark, f"{d}/events.parquet")).select("began", "event_type", "n", F.round("total", 4).alias("total"))


def sliding_windows(spark, d):
    ship(spark)
    return I.windowed_counts(spark, I.file_stream(spark, f"{d}/events.parquet"), size="2 hours", slide="1 hour").select("began", "event_type", "n", F.round("total", 4).alias("total"))


def first_deliveries(spark, d):
    ship(spark)
    return I.first_deliveries(spark, I.file_stream(spark, f"{d}/sft_examples.parquet"), "example_id", ["db_id"])


QUERIES = {f"stream_{f.__name__}": f for f in (event_windows, sliding_windows, first_deliveries)}
ORACLE = {
    "stream_event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS began, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding_windows": "SELECT b AS began, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS b, event_type, value FROM events) GROUP BY ALL",
    "stream_first_deliveries": "SELECT DISTINCT example_id, db_id FROM sft_examples",
}
