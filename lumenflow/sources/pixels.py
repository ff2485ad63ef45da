"""Bridge from a relational event log to pixel-addressed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def pixelised_events(
    spark: SparkSession,
    path: str,
    with_value: bool = False,
    since_us: int | None = None,
    until_us: int | None = None,
    sensors: int | None = None,
) -> DataFrame:
    """Map each log row to a pixel of a 24 x 18 sensor.

    ``seq`` is the log key, the pixel comes from the user and the key, and clicks and purchases
    count as positive polarity. Only the needed columns are read. ``since_us`` and ``until_us``
    (inclusive) are compared with the stored time itself, so they prune Parquet row groups. With
    ``sensors`` the users are dealt over that many streams instead of one.
    """
    log = spark.read.parquet(path)
    kind = log.schema["ts"].dataType
    if since_us is not None:
        log = log.where(F.col("ts") >= F.timestamp_micros(F.lit(since_us)).cast(kind))
    if until_us is not None:
        log = log.where(F.col("ts") <= F.timestamp_micros(F.lit(until_us)).cast(kind))
    # Not a plain literal: Catalyst would fold it out of join and partition keys.
    stream = F.when(F.col("event_id").isNotNull(), F.lit("events"))
    if sensors is not None:
        stream = F.concat(F.lit("sensor"), F.floor(F.col("user_id") / 24) % sensors)
    columns = [
        stream.alias("stream_id"),
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp_us"),
        (F.col("user_id") % 24).cast("int").alias("x"),
        ((F.col("event_id") * 7 + F.col("user_id")) % 18).cast("int").alias("y"),
        F.col("event_type").isin("click", "purchase").alias("polarity"),
    ]
    if with_value:
        columns.append("value")
    return log.select(*columns)
