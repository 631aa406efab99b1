"""Tables by name, and recordings read from an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUANTITIES = ("frequency", "pri", "pw")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(events: DataFrame) -> DataFrame:
    """One recording for each user: recording_id, event_idx, t (us from its start) and three measured quantities.

    pri follows from the preceding event, so the first is missing; a pulse width of 0 is missing.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    # Without a time zone, so that no clock change of the session's zone gets into differences.
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    width = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("user_id").alias("recording_id"),
        (F.row_number().over(order) - 1).alias("event_idx"),
        (at - F.min(at).over(Window.partitionBy("user_id"))).cast("double").alias("t"),
        F.col("value").alias("frequency"),
        (at - F.lag(at).over(order)).cast("double").alias("pri"),
        F.when(width != 0, width).alias("pw"),
    )
