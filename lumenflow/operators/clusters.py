"""Cells, clusters and the best cluster of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenflow.config import ClusterConfig
from lumenflow.operators.components import connected_cells
from lumenflow.plans.hopping import hop_aggregate


def cell_of(x: str | Column, size: int) -> Column:
    """Grid index of a non-negative pixel coordinate."""
    column = F.col(x) if isinstance(x, str) else x
    return F.floor(column / F.lit(size)).cast("int")


def _cell_measures() -> dict[str, tuple[Column, str]]:
    """What is known of a cell, and how parts of it merge."""
    bounds = {f"{f.__name__}_{a}": (f(a), f.__name__) for f in (F.min, F.max) for a in "xy"}
    return {"n": (F.count(F.lit(1)), "sum"), "sum_x": (F.sum("x"), "sum"), "sum_y": (F.sum("y"), "sum"), **bounds}


def _in_cells(events: DataFrame, cell_size: int) -> DataFrame:
    return events.withColumn("cx", cell_of("x", cell_size)).withColumn("cy", cell_of("y", cell_size))


def count_cells(events: DataFrame, keys: list[str], cell_size: int) -> DataFrame:
    """Per window and cell: event count, coordinate sums and bounds.

    The aggregate combines map-side, so a hot pixel or window shrinks before the shuffle.
    """
    measures = [made.alias(name) for name, (made, _) in _cell_measures().items()]
    return _in_cells(events, cell_size).groupBy(*keys, "cx", "cy").agg(*measures)


def hopping_cells(
    events: DataFrame, since_origin: Column, window_us: int, step_us: int, cell_size: int, **ids
) -> DataFrame:
    """``count_cells`` of every stream's hopping windows, without a row per event and window.

    ``ids`` are ``first``, ``last`` and ``name`` of the windows, as in ``hop_aggregate``.
    """
    cells = _in_cells(events, cell_size)
    keys = ["stream_id", "cx", "cy"]
    return hop_aggregate(cells, keys, since_origin, window_us, step_us, _cell_measures(), **ids)


def merge_cells(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cluster from its labelled cells."""
    merged = labelled.groupBy(*keys, "label").agg(
        F.sum("n").alias("event_count"),
        F.count(F.lit(1)).alias("cell_count"),
        F.sum("sum_x").alias("sum_x"),
        F.sum("sum_y").alias("sum_y"),
        F.min("min_x").alias("min_x"),
        F.min("min_y").alias("min_y"),
        F.max("max_x").alias("max_x"),
        F.max("max_y").alias("max_y"),
    )
    return merged.select(
        *keys,
        "label",
        "event_count",
        "cell_count",
        (F.col("sum_x") / F.col("event_count")).alias("centroid_x"),
        (F.col("sum_y") / F.col("event_count")).alias("centroid_y"),
        "min_x",
        "min_y",
        "max_x",
        "max_y",
    )


def eligible(clusters: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """Clusters large enough to report and small enough for one object."""
    return clusters.where(
        (F.col("event_count") >= cfg.min_events)
        & (F.col("cell_count") >= cfg.min_cells)
        & (F.col("max_x") - F.col("min_x") + 1 <= cfg.max_bbox_width)
        & (F.col("max_y") - F.col("min_y") + 1 <= cfg.max_bbox_height)
    )


def clusters_of(
    cells: DataFrame, keys: list[str], cfg: ClusterConfig, sensor: tuple[int, int] | None = None
) -> DataFrame:
    """All clusters of the windows whose cells are given."""
    grid = tuple(-(-side // cfg.cell_size) for side in sensor) if sensor else None
    return merge_cells(connected_cells(cells, keys, grid), keys)


def window_clusters(
    events: DataFrame, keys: list[str], cfg: ClusterConfig, sensor: tuple[int, int] | None = None
) -> DataFrame:
    """All clusters of every window in ``keys``."""
    return clusters_of(count_cells(events, keys, cfg.cell_size), keys, cfg, sensor)


def hopping_clusters(
    events: DataFrame, since_origin: Column, cfg: ClusterConfig, sensor: tuple[int, int] | None = None
) -> DataFrame:
    """All clusters of every hopping window of ``cfg``, as ``stream_id`` and ``window_id``."""
    cells = hopping_cells(events, since_origin, cfg.window_us, cfg.step_us, cfg.cell_size)
    return clusters_of(cells, ["stream_id", "window_id"], cfg, sensor)


def confidence(cfg: ClusterConfig) -> Column:
    """Support relative to the minimum, damped by the square root of the bbox density."""
    n = F.col("event_count")
    area = (F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1)
    support = F.least(n / F.lit(max(cfg.min_events, 1)), F.lit(1.0))
    return support * F.sqrt(F.least(n / area, F.lit(1.0)))


def best_cluster(clusters: DataFrame, keys: list[str], cfg: ClusterConfig) -> DataFrame:
    """The largest eligible cluster per window, without continuity; ties go to the lowest label."""
    ranked = Window.partitionBy(*keys).orderBy(F.desc("event_count"), "label")
    return (
        eligible(clusters, cfg)
        .withColumn("rank", F.row_number().over(ranked))
        .where("rank = 1")
        .drop("rank")
        .withColumn("confidence", confidence(cfg))
    )
