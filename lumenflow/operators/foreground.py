"""Moving foreground in compensated windows, and the focus measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lumenflow.config import CameraModel, MotionConfig
from lumenflow.functions.geometry import guarded_cell
from lumenflow.operators.components import connected_cells

EARLY = 0.25


def grid_of(camera: CameraModel, size: int) -> tuple[int, int]:
    return -(-camera.width // size), -(-camera.height // size)


def motion_cells(
    rows: DataFrame, keys: list[str], camera: CameraModel, cfg: MotionConfig, x: str = "px", y: str = "py"
) -> DataFrame:
    """Per window and cell: event count, mean normalised time and early count."""
    length = F.greatest(F.col("end_us") - F.col("start_us"), F.lit(1))
    age = F.greatest(F.col("timestamp_us") - F.col("start_us"), F.lit(0)) / length
    return (
        rows.withColumn("cx", guarded_cell(F.col(x), camera.width, cfg.cell_px))
        .withColumn("cy", guarded_cell(F.col(y), camera.height, cfg.cell_px))
        .where("cx is not null and cy is not null")
        .withColumn("age", age)
        .groupBy(*keys, "cx", "cy")
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.sum("age") / F.count(F.lit(1))).alias("mean_age"),
            F.count_if(F.col("age") < EARLY).alias("early"),
        )
    )


def late_cells(cells: DataFrame, keys: list[str], cfg: MotionConfig) -> DataFrame:
    """Add the window's mean cell age over occupied cells and whether a cell is a candidate.

    The window has at most as many rows as the sensor has cells.
    """
    occupied = F.col("n") >= cfg.min_events
    window_mean = F.avg(F.when(occupied, F.col("mean_age"))).over(Window.partitionBy(*keys))
    return cells.withColumn("window_age", window_mean).withColumn(
        "late", occupied & (F.col("mean_age") - F.col("window_age") > cfg.threshold)
    )


def foreground_regions(
    cells: DataFrame, keys: list[str], camera: CameraModel, cfg: MotionConfig
) -> DataFrame:
    """Candidate cells with region label, region size, new cells and the keep decision."""
    scored = late_cells(cells, keys, cfg)
    around = F.array(
        *[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    )
    here = F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy")))
    # Early counts go to the 3 x 3 neighbours; candidates only mark their own cell.
    support = (
        scored.where("late or early > 0")
        .withColumn("d", F.explode(F.when(F.col("early") > 0, around).otherwise(here)))
        .groupBy(*keys, (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
        .agg(
            F.sum("early").alias("early_support"),
            F.max(F.col("late") & (F.col("d.dx") == 0) & (F.col("d.dy") == 0)).alias("late"),
        )
        .where("late")
        .drop("late")
    )
    early = F.col("early_support") if cfg.min_new_fraction > 0 else F.lit(0)
    labelled = connected_cells(support, keys, grid_of(camera, cfg.cell_px))
    region = Window.partitionBy(*keys, "label")
    sized = labelled.withColumns(
        {
            "size": F.count(F.lit(1)).over(region),
            "new_cells": F.count_if(early < cfg.min_events).over(region),
        }
    )
    return sized.withColumn(
        "keep",
        (F.col("size") >= cfg.min_component_cells)
        & (F.col("new_cells") >= F.col("size") * F.lit(cfg.min_new_fraction)),
    )


def kept_cells(
    rows: DataFrame, keys: list[str], camera: CameraModel, cfg: MotionConfig, x: str = "px", y: str = "py"
) -> DataFrame:
    """Cells of every window's kept regions: a small table next to the events."""
    cells = motion_cells(rows, keys, camera, cfg, x, y)
    return foreground_regions(cells, keys, camera, cfg).where("keep").select(*keys, "cx", "cy")


def mark(
    rows: DataFrame,
    kept: DataFrame,
    keys: list[str],
    camera: CameraModel,
    cfg: MotionConfig,
    x: str = "px",
    y: str = "py",
    name: str = "foreground",
) -> DataFrame:
    """Add whether the event lies in a kept cell. ``rows`` may be any part of the windows' events."""
    marked = (
        rows.withColumn("cx", guarded_cell(F.col(x), camera.width, cfg.cell_px))
        .withColumn("cy", guarded_cell(F.col(y), camera.height, cfg.cell_px))
        .join(kept.withColumn("__kept", F.lit(True)), [*keys, "cx", "cy"], "left")
    )
    return marked.withColumn(name, F.coalesce("__kept", F.lit(False))).drop("cx", "cy", "__kept")


def segment(
    rows: DataFrame,
    keys: list[str],
    camera: CameraModel,
    cfg: MotionConfig,
    x: str = "px",
    y: str = "py",
    name: str = "foreground",
) -> DataFrame:
    """Add ``foreground``: the event lies in a kept region of its window."""
    return mark(rows, kept_cells(rows, keys, camera, cfg, x, y), keys, camera, cfg, x, y, name)


def focus(
    rows: DataFrame, keys: list[str], width: int, height: int, x: str = "px", y: str = "py", scale: int = 3
) -> DataFrame:
    """Energy of the bilinear event image per window; sharper alignment gives more.

    Each point splits its weight over four cells. Points in the last row or column are dropped.
    """
    columns, lines = -(-width // scale), -(-height // scale)
    gx, gy = F.col(x) / scale, F.col(y) / scale
    inside = (gx >= 0) & (gy >= 0) & (gx < columns - 1) & (gy < lines - 1)
    placed = rows.where(inside).select(
        *keys, F.floor(gx).alias("ix"), F.floor(gy).alias("iy"), (gx - F.floor(gx)).alias("fx"), (gy - F.floor(gy)).alias("fy")
    )
    fx, fy = F.col("fx"), F.col("fy")
    corners = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("part"))
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    cells = (
        placed.withColumn("c", F.explode(corners))
        .groupBy(*keys, (F.col("ix") + F.col("c.i")).alias("ix"), (F.col("iy") + F.col("c.j")).alias("iy"))
        .agg(F.sum("c.part").alias("weight"))
    )
    return cells.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("weight")).alias("focus"))
