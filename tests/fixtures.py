"""Synthetic sensor scenes. All are generated, with fixed seeds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenflow.config import CameraModel
from lumenflow.schema import EVENT
from lumenflow.sources.imu import rebase


def event_table(spark, rows, stream="s"):
    """Rows of (timestamp_us, x, y[, polarity])."""
    data = [
        (stream, i, int(r[0]), int(r[1]), int(r[2]), bool(r[3]) if len(r) > 3 else True)
        for i, r in enumerate(rows)
    ]
    frame = pd.DataFrame(data, columns=[f.name for f in EVENT.fields])
    return spark.createDataFrame(frame, schema=EVENT)


def imu_table(spark, times, gyro=(0.0, 0.0, 0.0), gravity=None, stream="s"):
    frame = pd.DataFrame({"stream_id": stream, "time_s": times, "__row": range(len(times))})
    for name, value in zip(("gx", "gy", "gz"), gyro):
        frame[name] = value
    if gravity is not None:
        for name, value in zip(("gravity_x", "gravity_y", "gravity_z"), gravity):
            frame[name] = value
    return rebase(spark.createDataFrame(frame), gravity is not None)


def window_rows(events, start_us, end_us, window_id=0):
    return events.withColumns(
        {
            "window_id": F.lit(window_id).cast("long"),
            "start_us": F.lit(start_us).cast("long"),
            "end_us": F.lit(end_us).cast("long"),
        }
    )


def simple_camera(focal, width, height):
    return CameraModel(focal, focal, width / 2, height / 2).for_sensor(width, height)


def turn_matrix(vector):
    """Rotation by ``|vector|`` about ``vector`` (Rodrigues)."""
    vector = np.asarray(vector, float)
    angle = np.linalg.norm(vector)
    if angle == 0:
        return np.eye(3)
    x, y, z = vector / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def projected(camera, points, turn):
    """Pixels of viewing directions after a turn, without lens distortion."""
    rays = turn @ np.vstack([(points[0] - camera.cx) / camera.fx, (points[1] - camera.cy) / camera.fy, np.ones(len(points[0]))])
    return camera.fx * rays[0] / rays[2] + camera.cx, camera.fy * rays[1] / rays[2] + camera.cy


def turning_scene(camera, rate, milliseconds, seed):
    """What a camera turning at ``rate`` (rad/s per axis) sees: fixed dots, and dots in one patch that drift.

    Rows of (timestamp_us, x, y, True); every dot fires now and then, in time order.
    """
    rng = np.random.default_rng(seed)
    fixed = rng.uniform([30, 30], [camera.width - 30, camera.height - 30], (260, 2)).T
    patch = rng.uniform([camera.width * 0.4, camera.height * 0.35], [camera.width * 0.5, camera.height * 0.6], (120, 2)).T
    drift = rng.uniform(-900, 900, 2)
    rows = []
    for ms in range(milliseconds):
        world = turn_matrix(np.multiply(rate, ms * 1e-3)).T  # directions as the turned camera sees them
        moved = patch + (drift * ms * 1e-3)[:, None]
        for dots, share in ((fixed, 0.3), (moved, 0.5)):
            some = dots[:, rng.random(dots.shape[1]) < share]
            for x, y in zip(*np.round(projected(camera, some, world))):
                if 0 <= x < camera.width and 0 <= y < camera.height:
                    rows.append((ms * 1000, int(x), int(y), True))
    return rows


def crossing_ball(milliseconds=400, start=(620.0, 150.0), velocity=(-700.0, 260.0), radius=26.0, seed=17):
    """A ball's outline that crosses the view before flickering pixels (720 x 540, still camera).

    Each millisecond shows a random two thirds of the outline, jittered by a fraction of a pixel.
    """
    rng = np.random.default_rng(seed)
    flicker = rng.integers([0, 0], [720, 540], size=(500, 2))
    rows = []
    for ms in range(milliseconds):
        angle = np.sort(rng.choice(240, 160, replace=False)) * math.tau / 240
        centre = np.array(start) + np.array(velocity) * ms * 1e-3
        edge = centre + radius * np.column_stack([np.cos(angle), np.sin(angle)]) + rng.normal(0, 0.2, (160, 2))
        rows += [(ms * 1000, int(x), int(y)) for x, y in flicker]
        rows += [(ms * 1000, int(round(x)), int(round(y))) for x, y in edge if 0 <= x < 719 and 0 <= y < 539]
    return rows
