"""Ingest of event files as a stream: windowed counts, and recordings appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and value ranges by recording and window; rows later than `late` are left out."""
    timed = events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("user_id").alias("recording_id"))
    sums = timed.agg(F.count(F.lit(1)).alias("n_events"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return sums.select("recording_id", F.col("window.start").alias("window_start"), "n_events", "min_value", "max_value")


def append_new(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append events to `target`, each id once. Ids seen before are the stream's state, so the target is never read; each
    batch has a folder of its own there, which a batch that is run again writes anew."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    once = events.dropDuplicates(["event_id"])
    return once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
