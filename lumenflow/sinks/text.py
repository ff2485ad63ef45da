"""Writers. Existing output is never replaced."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, functions as F

from lumenflow.config import InvalidConfig
from lumenflow.operators.alignment import Alignment
from lumenflow.operators.tracker import TRACK_NUMBERS


def detection_lines(detections: DataFrame, with_fit: bool = False) -> DataFrame:
    """One text line per detection, in ``line``; absent fits read ``none``."""
    c = F.col
    circle = (
        F.format_string(
            "circle=(%.2f,%.2f) r=%.2fpx inliers=%d ratio=%.3f err=%.2fpx",
            *[c(f"circle.{n}") for n in ("center_x", "center_y", "radius_px", "inlier_count", "inlier_ratio", "mean_error_px")],
        )
        if "circle" in detections.columns
        else F.lit(None).cast("string")
    )
    fit = (
        F.format_string(
            "parabola=p(%.2f,%.2f,%.2f)m v(%.2f,%.2f,%.2f)m/s inliers=%d/%d err=%.3fm",
            *[c(f"fit.{n}") for n in ("px", "py", "pz", "vx", "vy", "vz", "inlier_count", "total_count", "mean_error_m")],
        )
        if with_fit
        else F.lit(None).cast("string")
    )

    def shown(text: Column, present: Column, name: str) -> Column:
        return F.when(present, text).otherwise(F.lit(f"{name}=none"))

    has_circle = c("circle").isNotNull() if "circle" in detections.columns else F.lit(False)
    head = F.format_string(
        "t=%dus window=%d..%dus centroid=(%.2f,%.2f) bbox=(%d,%d)->(%d,%d) events=%d confidence=%.3f %s %s",
        c("timestamp_us"), c("window_start_us"), c("window_end_us"), c("centroid_x"), c("centroid_y"),
        c("min_x"), c("min_y"), c("max_x"), c("max_y"), c("event_count"), c("confidence"),
        shown(circle, has_circle, "circle"),
        shown(fit, c("fit").isNotNull() if with_fit else F.lit(False), "parabola"),
    )
    return detections.select("stream_id", "timestamp_us", head.alias("line"))


#: The 25 columns of a track file, in order; pixel numbers have two decimals, lengths four.
TRACK_FILE = ("time_s", "state", "track_id", "outline_supported", *TRACK_NUMBERS[:21])


def track_lines(tracks: DataFrame) -> DataFrame:
    """Tracks as they are written to a file: fixed decimals, empty cells where there is no value."""

    def cell(name: str) -> Column:
        if name in ("state", "track_id", "outline_supported"):
            return F.col(name).cast("string").alias(name)
        pattern = "%.2f" if name == "time_s" or name.endswith("_px") else "%.4f"
        return F.when(F.col(name).isNotNull() & ~F.isnan(name), F.format_string(pattern, name)).alias(name)

    return tracks.select("stream_id", "window_id", *[cell(n) for n in TRACK_FILE])


def write_tracks(tracks: DataFrame, path: str) -> None:
    """CSV folder, one subfolder per stream, rows in update order within each file."""
    lines = track_lines(tracks)
    ordered = lines.repartitionByRange("stream_id", "window_id").sortWithinPartitions("stream_id", "window_id")
    ordered.drop("window_id").write.mode("errorifexists").partitionBy("stream_id").csv(
        path, header=True, nullValue="", emptyValue=""
    )


def write_alignment(alignment: Alignment, path: str) -> None:
    """Two lines: the offset in seconds, then the mounting rotation row by row."""
    with open(path, "x", encoding="utf-8") as file:
        file.write(f"{alignment.offset_s!r}\n")
        file.write(",".join(repr(float(v)) for row in alignment.mount for v in row) + "\n")


def read_alignment(path: str) -> tuple[float, tuple]:
    """Offset and mounting rotation; the matrix must be a proper rotation."""
    with open(path, encoding="utf-8") as file:
        lines = file.read().split("\n")
    try:
        offset = float(lines[0])
        values = [float(v) for v in lines[1].split(",")]
    except (IndexError, ValueError) as error:
        raise InvalidConfig("alignment", f"cannot read {os.path.basename(path)}") from error
    return offset, check_mount(values, offset)


def check_mount(values: list[float], offset: float = 0.0) -> tuple:
    """Nine row-major numbers as a matrix; rejects anything but a rotation."""
    import numpy as np

    if len(values) != 9 or not np.isfinite([*values, offset]).all():
        raise InvalidConfig("imu_to_camera", "needs nine finite numbers")
    m = np.array(values).reshape(3, 3)
    if np.abs(m @ m.T - np.eye(3)).max() > 0.002 or np.linalg.det(m) < 0.99:
        raise InvalidConfig("imu_to_camera", "is not a proper rotation")
    return tuple(map(tuple, m.tolist()))
