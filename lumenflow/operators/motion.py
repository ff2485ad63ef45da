"""Rotation compensation of event windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenflow.config import CameraModel, MotionConfig
from lumenflow.functions import geometry as g
from lumenflow.operators.imu import QUATERNION, orientation_at
from lumenflow.plans.fence import fence
from lumenflow.plans.hopping import explode_hops, floor_div, hop_range
from lumenflow.plans.lineage import materialise
from lumenflow.plans.ordered import spread
from lumenflow.plans.sized import BROADCAST_ROWS, broadcast_if_small

KEYS = ["stream_id", "window_id"]
#: Rotations are computed every half millisecond and interpolated between.
BIN_US = 500
ROTATION = [f"r{i}{j}" for i in range(3) for j in range(3)]
#: Window ids generated per task from one stream's range.
GRID_CHUNK = 1 << 16
#: Windows of one slice: its events and rotations lie in the same task.
SLICE_WINDOWS = 32


def time_bounds(events: DataFrame) -> DataFrame:
    """Per stream: the earliest and the latest time, in whatever order the rows are numbered.

    Windows look events and samples up by time alone, so no event is outside these bounds.
    """
    return materialise(
        events.groupBy("stream_id").agg(F.min("timestamp_us").alias("origin_us"), F.max("timestamp_us").alias("last_us"))
    )


def grid_range(cfg: MotionConfig, start_s: float | None, end_s: float | None) -> tuple:
    """First and last grid step per stream, as columns over origin, last event and IMU duration.

    A window needs its whole length after the origin and inside the IMU's coverage.
    """
    w = cfg.window_us * 1e-6
    duration = (F.col("last_us") - F.col("origin_us")) * 1e-6
    start = F.lit(max(start_s or 0.0, w - cfg.offset_s, w))
    end = F.least(F.lit(end_s) if end_s is not None else duration, duration, F.col("duration_s") - cfg.offset_s)
    return (
        F.ceil((start * 1e6 + cfg.step_us) / cfg.step_us - 1e-9).cast("long"),
        F.floor((end * 1e6 - cfg.step_us) / cfg.step_us + 1e-9).cast("long"),
    )


def window_grid(
    bounds: DataFrame,
    intervals: DataFrame,
    cfg: MotionConfig,
    start_s: float | None = None,
    end_s: float | None = None,
) -> DataFrame:
    """Windows ending every step after each stream's origin: ``start_us``, ``end_us`` and times.

    The range of ids is generated in chunks, so one long recording does not become one row or task.
    """
    coverage = intervals.groupBy("stream_id").agg(F.first("duration_s").alias("duration_s"))
    first, last = grid_range(cfg, start_s, end_s)
    ranges = (
        bounds.join(coverage, "stream_id")
        .withColumns({"first_id": first, "last_id": last})
        .where("first_id <= last_id")
    )
    chunks = ranges.withColumn(
        "low", F.explode(F.sequence("first_id", "last_id", F.lit(GRID_CHUNK).cast("long")))
    ).repartition("stream_id", "low")
    high = F.least(F.col("low") + GRID_CHUNK - 1, F.col("last_id"))
    ids = chunks.withColumn("window_id", F.explode(F.sequence("low", high)))
    return window_times(
        ids.select(
            *KEYS,
            "origin_us",
            "first_id",
            "last_id",
            (F.col("origin_us") + F.col("window_id") * cfg.step_us).alias("end_us"),
        ),
        cfg,
    )


def window_times(windows: DataFrame, cfg: MotionConfig) -> DataFrame:
    """Add the window start, clamped to the origin, and both ends in IMU time."""
    start = F.greatest(F.col("end_us") - cfg.window_us, F.col("origin_us"))
    return windows.withColumn("start_us", start).withColumns(
        {
            "start_s": (F.col("start_us") - F.col("origin_us")) * 1e-6 + cfg.offset_s,
            "end_s": (F.col("end_us") - F.col("origin_us")) * 1e-6 + cfg.offset_s,
        }
    )


def window_events(events: DataFrame, windows: DataFrame, cfg: MotionConfig, sliced: bool = False) -> DataFrame:
    """One row per event and window that contains it, both ends included.

    Ids are computed per event; the windows' ranges come from one small row per stream. ``sliced``
    deals events over tasks by ``slice``, a run of windows, before they are copied to their windows.
    """
    ranges = windows.groupBy("stream_id").agg(
        F.first("origin_us").alias("origin_us"),
        F.min("window_id").alias("first_id"),
        F.max("window_id").alias("last_id"),
    )
    placed = events.join(broadcast_if_small(ranges), "stream_id").where(
        F.col("timestamp_us") >= F.col("origin_us")
    )
    since = F.col("timestamp_us") - F.col("origin_us")
    first, last = F.col("first_id"), F.col("last_id")
    if sliced:
        low, high = hop_range(since, cfg.window_us, cfg.step_us, first, last)
        placed = placed.withColumns({"__low": low, "__high": high}).where("__low <= __high")
        runs = F.sequence(slice_of(F.col("__low")), slice_of(F.col("__high")))
        placed = spread(placed.withColumn("slice", F.explode(runs)).drop("__low", "__high"), ["stream_id", "slice"])
        first = F.greatest(first, F.col("slice") * SLICE_WINDOWS)
        last = F.least(last, F.col("slice") * SLICE_WINDOWS + (SLICE_WINDOWS - 1))
    return (
        explode_hops(placed, since, cfg.window_us, cfg.step_us, first=first, last=last)
        .withColumn("end_us", F.col("origin_us") + F.col("window_id") * cfg.step_us)
        .withColumn("start_us", F.greatest(F.col("end_us") - cfg.window_us, F.col("origin_us")))
        .drop("origin_us", "first_id", "last_id")
    )


def slice_of(window: Column) -> Column:
    return floor_div(window, SLICE_WINDOWS)


def window_rotations(windows: DataFrame, intervals: DataFrame, cfg: MotionConfig) -> DataFrame:
    """Per covered window and time bin: rotation into the window's end orientation at both bin edges.

    A window is covered when both ends are and no gap touches the span. The rows of one window are
    the bins of one window length, a fixed small number.
    """
    bins = F.greatest(F.ceil((F.col("end_us") - F.col("start_us")) / BIN_US), F.lit(1)).cast("long")
    edges = (
        windows.withColumn("bins", bins)
        .withColumn("edge", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins"))))
        .withColumn(
            "time_s",
            F.when(F.col("edge") == F.col("bins"), F.col("end_s")).otherwise(
                F.col("start_s")
                + (F.col("end_s") - F.col("start_s")) * F.col("edge") / F.col("bins")
            ),
        )
        .select(*KEYS, "bins", "edge", "time_s")
    )
    q = F.struct("edge", *QUATERNION, "gap_count", "gap_floor")
    whole = (
        orientation_at(edges, intervals)
        .groupBy(*KEYS, "bins")
        .agg(F.sort_array(F.collect_list(q)).alias("e"))
        .where(F.size("e") == F.col("bins") + 1)
        .withColumn("ref", F.element_at("e", -1))
        .where(F.element_at("e", 1)["gap_floor"] == F.col("ref.gap_count"))
    )
    pairs = whole.select(
        *KEYS,
        "bins",
        "ref",
        F.posexplode(F.arrays_zip(F.slice("e", 1, F.col("bins")).alias("p"), F.slice("e", 2, F.col("bins")).alias("q"))).alias("bin", "pair"),
    )
    mount = g.lit_matrix(cfg.mount)
    for side in "pq":
        pairs = pairs.withColumn(side, F.col(f"pair.{side}"))
    reference = g.transpose(g.quaternion_matrix(tuple(F.col(f"ref.{n}") for n in QUATERNION)))
    for side in "pq":
        turn = g.quaternion_matrix(tuple(F.col(f"{side}.{n}") for n in QUATERNION))
        relative = g.multiply(reference, turn)
        pairs = pairs.withColumns(
            {f"__m{i}{j}": relative[i][j] for i in range(3) for j in range(3)}
        )
        held = tuple(tuple(F.col(f"__m{i}{j}") for j in range(3)) for i in range(3))
        mounted = g.multiply(g.multiply(mount, held), g.transpose(mount))
        pairs = pairs.withColumns(
            {f"{side}_r{i}{j}": mounted[i][j] for i in range(3) for j in range(3)}
        )
    return pairs.select(
        *KEYS, "bins", F.col("bin").cast("long").alias("bin"), *[f"{s}_{r}" for s in "pq" for r in ROTATION]
    )


def dealt_rotations(rotations: DataFrame) -> DataFrame:
    """Rotations with their ``slice``: broadcast if few, else dealt over tasks as ``window_events`` deals events.

    A table of almost equal rotations is small as a file, so Spark would broadcast any number of rows.
    """
    sliced = rotations.withColumn("slice", slice_of(F.col("window_id")))
    if rotations.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return F.broadcast(sliced)
    return spread(sliced, ["stream_id", "slice"]).hint("shuffle_hash")


def compensate(
    rows: DataFrame, rotations: DataFrame, camera: CameraModel, with_original: bool = False, covered_only: bool = False
) -> DataFrame:
    """Add ``px, py`` in the window's end orientation and ``covered``.

    ``rows`` come from ``window_events`` and ``rotations`` from a written ``window_rotations``
    table, which is counted to choose the join. Without coverage the position is only undistorted. A
    null position means outside the sensor or behind the camera. ``with_original`` also keeps
    the uncompensated position ``ox, oy``. ``covered_only`` leaves the other rows out at the join,
    which keeps the generated method below the 8000 bytes that the JVM compiles. Sliced rows meet
    their rotations without another shuffle where ``joined_in_place`` holds.
    """
    # Once and before the join: all that is computed behind it is one generated method. A null is outside.
    inside = F.col("__inside")
    rows = rows.withColumn("__inside", F.coalesce(g.in_image(camera, F.col("x"), F.col("y")), F.lit(False)))
    rows = g.undistort(rows, camera, F.col("x").cast("double"), F.col("y").cast("double"))
    length = F.greatest(F.col("end_us") - F.col("start_us"), F.lit(1))
    bins = F.greatest(F.ceil((F.col("end_us") - F.col("start_us")) / BIN_US), F.lit(1))
    place = F.least(F.greatest((F.col("timestamp_us") - F.col("start_us")) / length * bins, F.lit(0.0)), bins.cast("double"))
    rows = rows.withColumn("__at", place).withColumn(
        "bin", F.least(F.floor("__at"), bins - 1).cast("long")
    )
    if with_original:
        ox, oy = g.project(camera, (F.col("ray_x"), F.col("ray_y"), F.lit(1.0)))
        rows = rows.withColumns({"ox": fence(F.when(inside, ox)), "oy": fence(F.when(inside, oy))})
    w = F.col("__at") - F.col("bin")
    rotations = rotations.drop("bins")
    if covered_only:
        # Columns known to hold no null need no checks in the generated method.
        rotations = rotations.where(" and ".join(f"{side}_{r} is not null" for side in "pq" for r in ROTATION))
    keys = [*KEYS, "bin"]
    if "slice" in rows.columns:
        keys.append("slice")
        side = dealt_rotations(rotations)
    else:
        side = broadcast_if_small(rotations)
    joined = rows.join(side, keys, "inner" if covered_only else "left")
    blended = {
        r: F.col(f"p_{r}") * (1 - w) + F.col(f"q_{r}") * w for r in ROTATION
    }
    covered = F.lit(True) if covered_only else F.col("p_r00").isNotNull()
    joined = joined.withColumn("covered", covered).withColumns(blended)
    ray = (F.col("ray_x"), F.col("ray_y"), F.lit(1.0))
    matrix = tuple(tuple(F.col(f"r{i}{j}") for j in range(3)) for i in range(3))
    turned = g.rotate(matrix, ray)
    joined = joined.withColumns(
        {f"__v{k}": F.when(F.col("covered"), turned[k]).otherwise(ray[k]) for k in range(3)}
    )
    px, py = g.project(camera, tuple(F.col(f"__v{k}") for k in range(3)))
    seen = inside & px.isNotNull() & py.isNotNull()
    out = joined.withColumns({"px": fence(F.when(seen, px)), "py": fence(F.when(seen, py))})
    extra = ["ox", "oy"] if with_original else []
    base = [c for c in rows.columns if c not in ("ray_x", "ray_y", "__at", "__inside", "bin", *extra)]
    return out.select(*base, "covered", "px", "py", *extra)
