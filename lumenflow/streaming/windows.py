"""Streaming cell counts in hopping windows, and detections of each finished window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lumenflow.config import ClusterConfig
from lumenflow.operators.clusters import best_cluster, count_cells, merge_cells
from lumenflow.operators.components import connected_cells

KEYS = ["stream_id", "tick_us"]


def cell_stream(events: DataFrame, cfg: ClusterConfig, lateness_us: int) -> DataFrame:
    """Cell counts of windows ``[tick - window, tick]``, emitted once the watermark passes.

    Both ends are closed: on whole microseconds that is a half-open window one longer.
    """
    timed = events.withColumn("at", F.timestamp_micros("timestamp_us")).withWatermark(
        "at", f"{lateness_us} microseconds"
    )
    window = F.window(
        "at",
        f"{cfg.window_us + 1} microseconds",
        f"{cfg.step_us} microseconds",
        f"{-cfg.window_us % cfg.step_us} microseconds",
    )
    placed = timed.withColumn("window", window)
    cells = count_cells(placed, ["stream_id", "window"], cfg.cell_size)
    return cells.withColumn("tick_us", F.unix_micros("window.end") - 1).drop("window")


def detect(cells: DataFrame, cfg: ClusterConfig, sensor: tuple[int, int] | None = None) -> DataFrame:
    """Best cluster of each finished window; use on the batches of ``cell_stream``."""
    grid = tuple(-(-side // cfg.cell_size) for side in sensor) if sensor else None
    return best_cluster(merge_cells(connected_cells(cells, KEYS, grid), KEYS), KEYS, cfg)


def detection_sink(path: str, cfg: ClusterConfig, sensor=None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: one folder per batch id, replaced when a batch is retried."""

    def write(cells: DataFrame, batch_id: int) -> None:
        detect(cells, cfg, sensor).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
