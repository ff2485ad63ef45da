"""Ball position from detections: depth from size, smoothing, ballistic fit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from lumenflow.config import BallConfig, ParabolaConfig
from lumenflow.functions.geometry import bbox_height, bbox_width, pixel_diameter, undistort
from lumenflow.functions.parabola import FIT_TYPE, fit_parabolas
from lumenflow.plans.frames import last_rows
from lumenflow.plans.hopping import floor_div
from lumenflow.plans.lineage import materialise
from lumenflow.plans.ordered import scan_ordered
from lumenflow.plans.scan import running


def ball_measurements(detections: DataFrame, cfg: BallConfig) -> DataFrame:
    """Camera position ``x_m, y_m, z_m`` from the pixel diameter and the known ball diameter.

    With ``enabled=False`` nothing is measured: the same columns, no rows.
    """
    camera = cfg.camera
    sized = detections.withColumn(
        "pixel_diameter", pixel_diameter(cfg.diameter_source, "circle" in detections.columns)
    ).where((F.col("pixel_diameter") > 0) & F.lit(cfg.enabled))
    deep = sized.withColumn("z_m", F.lit(camera.fx * cfg.diameter_m) / F.col("pixel_diameter"))
    return deep.withColumns(
        {
            "x_m": (F.col("centroid_x") - camera.cx) * F.col("z_m") / camera.fx,
            "y_m": (F.col("centroid_y") - camera.cy) * F.col("z_m") / camera.fy,
        }
    )


#: Fixed values of the per-axis constant-velocity filter.
PROCESS_NOISE = 0.05
MEASUREMENT_NOISE = 0.02
MIN_STEP_S = 1e-6


AXES = ["x_m", "y_m", "z_m"]
#: Paths are smoothed in time blocks of this length.
SMOOTHING_BLOCK_US = 60_000_000


def _step_s(before_us: np.ndarray, at_us: np.ndarray) -> np.ndarray:
    return np.maximum(np.maximum(at_us - before_us, 0) * 1e-6, MIN_STEP_S)


def filter_elements(dt: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each update as a map of the state before: (A, b, C, eta, J), with one b and eta per axis.

    A state of mean m and covariance P goes to A (1 + P J)^-1 (m + P eta) + b and A (1 + P J)^-1 P A' + C. Maps
    of neighbouring stretches of time compose to one of the same form (Sarkka and Garcia-Fernandez, 2021).
    """
    n = len(dt)
    move = np.zeros((n, 2, 2))
    move[:, 0, 0] = move[:, 1, 1] = 1.0
    move[:, 0, 1] = dt
    noise = np.zeros((n, 2, 2))
    noise[:, 0, 0], noise[:, 1, 1] = PROCESS_NOISE * dt * dt, PROCESS_NOISE
    spread_ = noise[:, 0, 0] + MEASUREMENT_NOISE
    gain = noise[:, :, 0] / spread_[:, None]
    left = np.tile(np.eye(2), (n, 1, 1))
    left[:, :, 0] -= gain
    seen = move[:, 0, :]  # the measured row after the move
    return (
        left @ move,
        gain[:, :, None] * z[:, None, :],
        left @ noise,
        (seen / spread_[:, None])[:, :, None] * z[:, None, :],
        seen[:, :, None] * seen[:, None, :] / spread_[:, None, None],
    )


def compose(first: tuple[np.ndarray, ...], then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The maps ``first`` and, after them, ``then``, element by element."""
    a1, b1, c1, e1, j1 = first
    a2, b2, c2, e2, j2 = then
    inner = np.linalg.inv(np.eye(2) + c1 @ j2)
    through, back = a2 @ inner, a1.swapaxes(-1, -2) @ inner.swapaxes(-1, -2)
    return (
        through @ a1,
        through @ (b1 + c1 @ e2) + b2,
        through @ c1 @ a2.swapaxes(-1, -2) + c2,
        back @ (e2 - j2 @ b1) + e1,
        back @ j2 @ a1 + j1,
    )


def composed(maps: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """All maps, in order, as one: neighbours are composed in pairs until one is left."""
    while len(maps[0]) > 1:
        even = len(maps[0]) // 2 * 2
        pairs = compose(tuple(x[0:even:2] for x in maps), tuple(x[1:even:2] for x in maps))
        maps = tuple(np.concatenate([x, y[even:]]) for x, y in zip(pairs, maps))
    return tuple(x[0] for x in maps)


MAP = ("a", "b", "c", "eta", "j")


def _block_map(rows: pd.DataFrame) -> pd.DataFrame:
    """One row: the map of a whole block. The first measurement of a stream forgets what was before."""
    rows = rows.sort_values(["timestamp_us", *AXES], kind="stable")
    z = rows[AXES].to_numpy(float)
    first = rows["before_us"].isna().to_numpy()
    at = rows["timestamp_us"].to_numpy()
    maps = filter_elements(_step_s(rows["before_us"].fillna(0).to_numpy("int64"), at), z)
    for name, x in zip(MAP, maps):
        x[first] = np.eye(2) if name == "c" else 0.0
    maps[1][first, 0, :] = z[first]
    out = {k: [rows[k].iloc[0]] for k in ("stream_id", "__block")}
    return pd.DataFrame(out | {k: [x.ravel().tolist()] for k, x in zip(MAP, composed(maps))} | {"last_us": [at[-1]]})


def _entries():
    """Over the blocks of a stream: time, mean and covariance with which each begins."""
    state = None

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        nonlocal state
        out = []
        for row in rows.itertuples(index=False):
            out.append((row.stream_id, row[1], *(state or (None, None, None))))
            a, b, c, eta, j = (np.reshape(getattr(row, k), (2, -1)) for k in MAP)
            mean, p = (np.zeros((2, 3)), np.eye(2)) if state is None else (np.reshape(x, (2, -1)) for x in state[1:])
            through = a @ np.linalg.inv(np.eye(2) + p @ j)
            state = row.last_us, (through @ (mean + p @ eta) + b).ravel().tolist(), (through @ p @ a.T + c).ravel().tolist()
        return pd.DataFrame(out, columns=["stream_id", "__block", "entry_us", "entry_mean", "entry_cov"]).astype({"entry_us": "Int64"})

    return step


def _smoother():
    """The filter over one block, from the state with which it begins.

    Three independent axes share one covariance, because their noise settings are equal.
    """
    state = None

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        nonlocal state
        times = rows["timestamp_us"].to_numpy()
        measured = rows[AXES].to_numpy(float)
        if state is None and rows["entry_mean"].iloc[0] is not None:
            entry = rows.iloc[0]
            position, velocity = np.reshape(entry["entry_mean"], (2, 3))
            state = (int(entry["entry_us"]), position, velocity, np.reshape(entry["entry_cov"], (2, 2)))
        out = np.empty((len(rows), 6))
        for i, (at, z) in enumerate(zip(times, measured)):
            if state is None:
                state = (at, z.copy(), np.zeros(3), np.eye(2))
            else:
                last, position, velocity, p = state
                dt = max(max(int(at) - int(last), 0) * 1e-6, MIN_STEP_S)
                move = np.array([[1.0, dt], [0.0, 1.0]])
                p = move @ p @ move.T + PROCESS_NOISE * np.diag([dt * dt, 1.0])
                position = position + velocity * dt
                gain = p[:, 0] / (p[0, 0] + MEASUREMENT_NOISE)
                residual = z - position
                p = p - np.outer(gain, p[0])
                state = (at, position + gain[0] * residual, velocity + gain[1] * residual, p)
            out[i, :3], out[i, 3:] = state[1], state[2]
        result = rows.drop(columns=["__block", "entry_us", "entry_mean", "entry_cov"])
        for k, name in enumerate(SMOOTHED):
            result[name] = out[:, k]
        result["speed_mps"] = np.sqrt((out[:, 3:] ** 2).sum(axis=1))
        return result

    return step


SMOOTHED = ("smooth_x_m", "smooth_y_m", "smooth_z_m", "vx_mps", "vy_mps", "vz_mps")


def smooth_path(measurements: DataFrame, block_us: int = SMOOTHING_BLOCK_US) -> DataFrame:
    """Constant-velocity Kalman path per stream over ball measurements, in parallel over time.

    Each block of time becomes one map from the state before it to the state behind it; only these maps, one
    row a block, are passed through in order. Every block is then filtered from its own first state, so the
    path does not depend on ``block_us``. Rows of one time go by their position.
    """
    rows = measurements.select("stream_id", "timestamp_us", *AXES, "pixel_diameter", "confidence")
    placed = rows.withColumns(
        {"__order": F.struct("timestamp_us", *AXES), "__block": floor_div(F.col("timestamp_us"), block_us)}
    )
    before = {"before_us": F.col("timestamp_us")}
    steps = materialise(running(placed, ["stream_id"], "__order", F.col("__block"), last=before).drop("__order"))
    maps = steps.groupBy("stream_id", "__block").applyInPandas(
        _block_map, "stream_id string, __block long, " + "".join(f"{k} array<double>, " for k in MAP) + "last_us long"
    )
    entries = scan_ordered(
        maps, ["stream_id"], ["__block"], _entries,
        "stream_id string, __block long, entry_us long, entry_mean array<double>, entry_cov array<double>",
    )
    added = [T.StructField(n, T.DoubleType()) for n in (*SMOOTHED, "speed_mps")]
    schema = T.StructType([*rows.schema.fields, *added])
    entered = steps.drop("before_us").join(entries, ["stream_id", "__block"]).select(
        *rows.columns, "__block", "entry_us", "entry_mean", "entry_cov"
    )
    return scan_ordered(entered, ["stream_id", "__block"], ["timestamp_us", *AXES], _smoother, schema)


def parabola_points(detections: DataFrame, cfg: ParabolaConfig) -> DataFrame:
    """Position from the bounding ellipse's area, on the undistorted bearing, inside the depth gate."""
    camera = cfg.camera
    ball_area = math.pi * (cfg.ball_diameter_m / 2) ** 2
    sized = detections.withColumn("pixel_area", bbox_width() * bbox_height() * F.lit(math.pi / 4))
    deep = sized.withColumn(
        "z_m", F.lit(camera.fx) * F.sqrt(F.lit(ball_area) / F.col("pixel_area"))
    ).where(F.col("z_m").between(cfg.min_depth_m, cfg.max_depth_m))
    return (
        undistort(deep, camera, F.col("centroid_x"), F.col("centroid_y"))
        .withColumns({"x_m": F.col("ray_x") * F.col("z_m"), "y_m": F.col("ray_y") * F.col("z_m")})
        .drop("ray_x", "ray_y")
    )


#: Points of a stream are numbered in time blocks of this length.
NUMBERING_BLOCK_US = 600_000_000


def parabola_fits(points: DataFrame, cfg: ParabolaConfig, order: str = "timestamp_us") -> DataFrame:
    """Ballistic fit over the last ``buffer_len`` points at every point; null without a fit."""
    point = F.struct("timestamp_us", "x_m", "y_m", "z_m")
    block = floor_div(F.col(order), NUMBERING_BLOCK_US)
    buffered = last_rows(points, ["stream_id"], order, block, cfg.buffer_len, {"__buffer": point})
    arrays = [F.col(f"__buffer.{n}") for n in ("timestamp_us", "x_m", "y_m", "z_m")]
    fitted = buffered.withColumn("fit", fit_parabolas(cfg)(*arrays))
    return fitted.select(*points.columns, F.when(F.col("fit.inlier_count") > 0, F.col("fit")).alias("fit"))


__all__ = [
    "FIT_TYPE",
    "ball_measurements",
    "parabola_fits",
    "parabola_points",
    "smooth_path",
]
