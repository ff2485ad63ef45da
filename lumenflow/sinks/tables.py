"""Prepared tables: events clustered for time-range reads, run summaries, image frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_events(events: DataFrame, path: str) -> None:
    """Parquet, one folder per stream, files and row groups in time order.

    A time-range read then skips whole files and row groups. The range partitioning samples the
    keys, so a long stream is spread over many files.
    """
    ordered = events.repartitionByRange("stream_id", "timestamp_us", "seq").sortWithinPartitions(
        "stream_id", "timestamp_us", "seq"
    )
    ordered.write.mode("errorifexists").partitionBy("stream_id").parquet(path)


def recent_events(rows: DataFrame, age_us: int = 10_000) -> DataFrame:
    """Newest positioned events per window with their age and foreground flag."""
    age = F.col("end_us") - F.col("timestamp_us")
    return rows.where((age <= age_us) & F.col("px").isNotNull()).select(
        "stream_id", "window_id", "px", "py", (age / 1000).alias("age_ms"), "foreground"
    )


def segments_json(segments: DataFrame) -> DataFrame:
    """One JSON line per track with its contiguous measured segments."""
    item = F.struct("start_s", "end_s", "updates")
    lists = segments.groupBy("stream_id", "track_id").agg(F.sort_array(F.collect_list(item)).alias("segments"))
    return lists.select(F.to_json(F.struct("stream_id", "track_id", "segments")).alias("line"))
