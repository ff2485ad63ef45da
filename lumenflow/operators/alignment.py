"""Time offset and mounting rotation between camera and inertial sensor."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from lumenflow.config import CameraModel, InvalidConfig
from lumenflow.functions import geometry as g
from lumenflow.operators.foreground import focus
from lumenflow.operators.imu import gyro_at
from lumenflow.operators.rolling import stream_bounds, with_origin
from lumenflow.plans.fence import fence
from lumenflow.plans.hopping import floor_div
from lumenflow.plans.lineage import materialise
from lumenflow.plans.scan import running
from lumenflow.plans.thin import evenly, thinned_rank
from lumenflow.sources.imu import GYRO

# Fixed values of the calibration sample.
SLOT_US = 350_000
SAMPLE_US = 30_000
MIN_WINDOW_EVENTS = 1500
WINDOW_POINTS = 5000
FIT_POINTS = 2500
MAX_WINDOWS = 40
BORDER_PX = 50
# Fixed values of the search.
MIN_GYRO = 0.08
MIN_USED = 6
COARSE_STEP_S = 0.1
REFINE_STEPS = (0.06, 0.025, 0.01, 0.004)
REFINE_ROUNDS = 10
MIN_GAIN = 1.05
#: Members of a slot are ranked in blocks of this many ``seq`` values.
RANK_BLOCK = 1 << 25


def calibration_windows(events: DataFrame, min_events: int = MIN_WINDOW_EVENTS) -> DataFrame:
    """Short samples spread over the recording: the first 30 ms of every 350 ms slot.

    Slots with enough events are thinned to at most 5000 events spread over the slot, and at most 40 slots
    per stream are kept by a stride over the slots. The recording is read once and only the
    sampled share of each slot is shuffled.
    """
    since = F.col("timestamp_us") - F.col("origin_us")
    placed = with_origin(events, stream_bounds(events)).withColumn("slot", floor_div(since, SLOT_US))
    sampled = placed.where(since - F.col("slot") * SLOT_US < SAMPLE_US)
    slots = sampled.groupBy("stream_id", "slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_events)
    one = F.lit(1).cast("long")
    numbered = running(
        slots, ["stream_id"], "slot", floor_div(F.col("slot"), 1 << 16), total={"r": one}
    ).join(slots.groupBy("stream_id").agg(F.count(F.lit(1)).alias("m")), "stream_id")
    chosen = numbered.where(F.col("r") % F.greatest(F.ceil(F.col("m") / MAX_WINDOWS), F.lit(1)) == 0)
    thinned = running(
        sampled.join(chosen.select("stream_id", "slot", "n"), ["stream_id", "slot"]),
        ["stream_id", "slot"],
        "seq",
        floor_div(F.col("seq"), RANK_BLOCK),
        total={"rank": one},
    )
    rank, n = F.col("rank"), F.col("n")
    return thinned.where(evenly(rank, n, WINDOW_POINTS)).select(
        *events.columns, "origin_us", "slot", thinned_rank(rank, n, WINDOW_POINTS).cast("int").alias("rank")
    )


@dataclass(frozen=True)
class Alignment:
    offset_s: float
    mount: tuple
    focus_gain: float
    windows: int


def proper_mounts() -> list[tuple]:
    """The 24 right-handed signed axis permutations."""
    found = []
    for axes in itertools.permutations(range(3)):
        parity = 1 if axes in ((0, 1, 2), (1, 2, 0), (2, 0, 1)) else -1
        for signs in itertools.product((-1.0, 1.0), repeat=3):
            if parity * math.prod(signs) > 0:
                found.append(
                    tuple(tuple(signs[i] if j == axes[i] else 0.0 for j in range(3)) for i in range(3))
                )
    return found


def fit_points(samples: DataFrame, camera: CameraModel) -> tuple[DataFrame, DataFrame]:
    """Rays with their time from the window centre, and each window's uncompensated focus."""
    key = ["stream_id", "slot"]
    whole = Window.partitionBy(*key)
    centred = samples.withColumns(
        {
            "n": F.count(F.lit(1)).over(whole),
            "centre_us": (F.min("timestamp_us").over(whole) + F.max("timestamp_us").over(whole)) * 0.5,
        }
    )
    x, y = F.col("x"), F.col("y")
    cropped = centred.where(
        evenly(F.col("rank"), F.col("n"), FIT_POINTS)
        & (x > BORDER_PX)
        & (y > BORDER_PX)
        & (x + BORDER_PX < camera.width)
        & (y + BORDER_PX < camera.height)
    )
    rays = g.undistort(cropped, camera, x.cast("double"), y.cast("double")).select(
        *key,
        "ray_x",
        "ray_y",
        ((F.col("timestamp_us") - F.col("centre_us")) * 1e-6).alias("dt"),
        ((F.col("centre_us") - F.col("origin_us")) * 1e-6).alias("time_s"),
    )
    rays = materialise(rays)
    px, py = g.project(camera, (F.col("ray_x"), F.col("ray_y"), F.lit(1.0)))
    flat = rays.withColumns({"px": fence(px), "py": fence(py)})
    baseline = materialise(
        focus(flat, [*key, "time_s"], camera.width, camera.height).where("focus > 0").withColumnRenamed("focus", "baseline")
    )
    return rays, baseline


def every_pair(offsets: list[float], mounts: list[tuple]):
    """Trials of all combinations, numbered offset first, as a step on the window table."""
    flat = F.array(*[F.array(*[F.lit(float(v)) for row in m for v in row]) for m in mounts])

    def expand(windows: DataFrame) -> DataFrame:
        return (
            windows.select("*", F.posexplode(F.array(*[F.lit(float(t)) for t in offsets])).alias("t", "offset_s"))
            .select("*", F.posexplode(flat).alias("m", "mount"))
            .withColumn("trial", F.col("t") * len(mounts) + F.col("m"))
        )

    return expand


def listed(trials: list[tuple[float, tuple]]):
    """A short list of (offset, mount) trials, as a step on the window table."""
    rows = [
        F.struct(
            F.lit(float(t)).alias("offset_s"), F.array(*[F.lit(float(v)) for row in m for v in row]).alias("mount")
        )
        for t, m in trials
    ]
    return lambda windows: windows.select("*", F.posexplode(F.array(*rows)).alias("trial", "c")).select("*", "c.*")


def score(
    expand, rays: DataFrame, baseline: DataFrame, intervals: DataFrame, camera: CameraModel
) -> DataFrame:
    """Mean log focus gain of every trial, in one job.

    Each of the at most 40 windows is expanded to its trials by ``expand``; a window's points then
    meet its trials by an equi join on the window.
    """
    key = ["stream_id", "slot"]
    trials = expand(baseline).select(
        *key,
        "baseline",
        "trial",
        (F.col("time_s") + F.col("offset_s")).alias("time_s"),
        *[F.col("mount")[3 * i + j].alias(f"m{i}{j}") for i in range(3) for j in range(3)],
    )
    turning = gyro_at(trials, intervals)
    turning = turning.where(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz") >= MIN_GYRO**2)
    omega = [sum((F.col(f"m{i}{j}") * F.col(a) for j, a in enumerate(GYRO)), F.lit(0.0)) for i in range(3)]
    rates = turning.select(*key, "trial", "baseline", *[w.alias(f"w{k}") for k, w in enumerate(omega)])
    ray = (F.col("ray_x"), F.col("ray_y"), F.lit(1.0))
    w = [F.col(f"w{k}") for k in range(3)]
    cross = [w[1] * ray[2] - w[2] * ray[1], w[2] * ray[0] - w[0] * ray[2], w[0] * ray[1] - w[1] * ray[0]]
    moved = rays.drop("time_s").join(rates, key).withColumns(
        {f"v{k}": ray[k] + cross[k] * F.col("dt") for k in range(3)}
    )
    px, py = g.project(camera, tuple(F.col(f"v{k}") for k in range(3)))
    placed = moved.withColumns({"px": fence(px), "py": fence(py)})
    gains = focus(placed, [*key, "trial"], camera.width, camera.height).join(rates, [*key, "trial"])
    return (
        gains.groupBy("trial")
        .agg(
            F.avg(F.ln(F.greatest(F.col("focus") / F.col("baseline"), F.lit(1e-12)))).alias("score"),
            F.count(F.lit(1)).alias("used"),
        )
        .where(F.col("used") >= MIN_USED)
    )


def _turned(axis: int, angle: float, mount) -> tuple:
    c, s = math.cos(angle), math.sin(angle)
    i, j = (axis + 1) % 3, (axis + 2) % 3
    rows = [list(r) for r in mount]
    turned = [list(r) for r in mount]
    turned[i] = [c * a - s * b for a, b in zip(rows[i], rows[j])]
    turned[j] = [s * a + c * b for a, b in zip(rows[i], rows[j])]
    return tuple(tuple(r) for r in turned)


def auto_align(
    events: DataFrame,
    intervals: DataFrame,
    camera: CameraModel,
    center_s: float = 0.0,
    radius_s: float = 4.0,
    min_events: int = MIN_WINDOW_EVENTS,
) -> Alignment:
    """Search offset and mounting of one stream, coarse over all axis mappings, then refined.

    Each search step is one Spark job over a fixed number of trials; only their scores come back.
    The refinement changes one coordinate at a time and keeps an improvement at once.
    """
    rays, baseline = fit_points(materialise(calibration_windows(events, min_events)), camera)

    def scores(expand):
        found = score(expand, rays, baseline, intervals, camera).collect()
        return sorted((r.trial, r.score, r.used) for r in found)

    ticks = math.ceil(radius_s * 20) + 1
    offsets = [center_s - radius_s + k * COARSE_STEP_S for k in range(ticks)]
    mounts = proper_mounts()
    coarse = scores(every_pair(offsets, mounts))
    if not coarse:
        raise InvalidConfig("alignment", "not enough overlapping camera and inertial motion")
    trial, best, used = max(coarse, key=lambda r: r[1])
    offset, mount = offsets[trial // len(mounts)], mounts[trial % len(mounts)]

    def moved(axis, sign, step):
        if axis == 3:
            return offset + sign * step, mount
        return offset, _turned(axis, sign * step, mount)

    order = [(axis, sign) for axis in range(4) for sign in (-1, 1)]
    for step in REFINE_STEPS:
        for _ in range(REFINE_ROUNDS):
            place, changed = 0, False
            while place < len(order):
                # All remaining moves in one job; the first improvement is taken, the rest is redone.
                tried = [moved(axis, sign, step) for axis, sign in order[place:]]
                hit = next((r for r in scores(listed(tried)) if r[1] > best), None)
                if hit is None:
                    break
                (offset, mount), best, used = tried[hit[0]], hit[1], hit[2]
                place, changed = place + hit[0] + 1, True
            if not changed:
                break
    gain = math.exp(best)
    if gain < MIN_GAIN:
        raise InvalidConfig("alignment", f"weak fit, focus gain {gain:.3f}")
    return Alignment(offset, mount, gain, used)
