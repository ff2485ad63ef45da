"""Summaries of runs and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenflow.config import IDENTITY, CameraModel
from lumenflow.functions import geometry as g
from lumenflow.plans.fence import fence
from lumenflow.plans.frames import last_rows, recent_rows
from lumenflow.plans.hopping import floor_div
from lumenflow.plans.lineage import materialise
from lumenflow.plans.scan import running
from lumenflow.plans.sized import broadcast_if_small

CHECK_US = 100_000
PATH_STEP_S = 0.02
#: How long a measured place stays in the trail.
TRAIL_US = 350_000


#: Values between two splitters are ordered in this many ranges.
VALUE_RANGES = 1 << 12
#: Accuracy of the sketch that splitters come from, and how many of its errors a bracket reaches to each side.
SKETCH_ACCURACY = 10_000
SKETCH_MARGIN = 3


def index_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentile by index: element ``min(floor(n p), n - 1)`` of the sorted values.

    A sketch gives two splitters around every share. Values below a bracket are only counted; those
    inside, a small share of a key whatever its outliers, are ranked by a scan split into value
    ranges. A bracket that misses its element by its counts is opened to all values, so results are
    exact. Null values are left out; a key that holds null is no key.
    """
    known = df.where(F.col(value).isNotNull())
    reach = SKETCH_MARGIN / SKETCH_ACCURACY
    sides = [min(max(p + side, 0.0), 1.0) for p in shares.values() for side in (-reach, reach)]
    sizes = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.max(value).alias("__high"),
        F.percentile_approx(value, sides, SKETCH_ACCURACY).alias("__sides"),
    )
    brackets = materialise(
        sizes.withColumn(
            "__b",
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(name).alias("share"),
                            F.least(F.floor(F.col("__n") * F.lit(p)), F.col("__n") - 1).alias("at"),
                            F.col("__sides")[2 * i].alias("low"),
                            F.col("__sides")[2 * i + 1].alias("high"),
                        )
                        for i, (name, p) in enumerate(shares.items())
                    ]
                )
            ),
        ).select(*keys, "__n", "__high", "__b.*")
    )
    counted = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__m"))
    sided = counted.join(broadcast_if_small(brackets), keys)
    # Below and inside every bracket: one small row per key and share.
    here = (F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high"))
    checked = sided.groupBy(*keys, "share").agg(
        *[F.first(c).alias(c) for c in ("__n", "__high", "at", "low", "high")],
        F.sum(F.when(F.col(value) < F.col("low"), F.col("__m")).otherwise(0)).alias("before"),
        F.sum(F.when(here, F.col("__m")).otherwise(0)).alias("inside"),
    )
    holds = (F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("inside"))
    ranges = materialise(checked.withColumn("holds", holds))
    near = counted.join(broadcast_if_small(ranges), keys).where(~F.col("holds") | here)
    # Values outside the splitters, met in an opened bracket only, are ranges of their own.
    width = (F.col("high") - F.col("low")) / VALUE_RANGES
    inner = F.coalesce(F.floor((F.col(value) - F.col("low")) / F.when(width > 0, width)), F.lit(0))
    part = F.when(F.col(value) < F.col("low"), -1).when(F.col(value) >= F.col("high"), VALUE_RANGES).otherwise(inner)
    ranked = running(near, [*keys, "share"], value, part, total={"__to": F.col("__m")}, include_current=True)
    rank = F.col("at") - F.when(F.col("holds"), F.col("before")).otherwise(0)
    hit = (F.col("__to") > rank) & (F.col("__to") - F.col("__m") <= rank)
    picks = [F.max(F.when(hit & (F.col("share") == name), F.col(value))).alias(name) for name in shares]
    return ranked.groupBy(*keys).agg(*picks, F.max("__high").alias("max"), F.max("__n").alias("n"))


def state_counts(tracks: DataFrame, keys: list[str]) -> DataFrame:
    return tracks.groupBy(*keys).agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("measured", "predicted", "lost")]
    )


def track_summary(tracks: DataFrame) -> DataFrame:
    """Span, update counts and depth range of every track, over measured updates only."""
    return (
        tracks.where("state = 'measured'")
        .groupBy("stream_id", "track_id")
        .agg(
            F.min("time_s").alias("start_s"),
            F.max("time_s").alias("end_s"),
            F.count(F.lit(1)).alias("measured"),
            F.count_if("outline_supported").alias("outlines"),
            F.min("z_m").alias("min_depth_m"),
            F.max("z_m").alias("max_depth_m"),
        )
    )


def measured_segments(tracks: DataFrame) -> DataFrame:
    """Contiguous runs of measured updates per track."""
    measured = tracks.where("state = 'measured'")
    by_track = Window.partitionBy("stream_id", "track_id").orderBy("window_id")
    run = F.col("window_id") - F.row_number().over(by_track)
    return (
        measured.withColumn("run", run)
        .groupBy("stream_id", "track_id", "run")
        .agg(F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s"), F.count(F.lit(1)).alias("updates"))
        .drop("run")
    )


def deadline_summary(df: DataFrame, keys: list[str], milliseconds: str, budget_ms: float) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("updates"),
        F.count_if(F.col(milliseconds) > budget_ms).alias("misses"),
        F.max(milliseconds).alias("max_ms"),
    )


def window_rates(rows: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """Events, foreground events and event rate per window."""
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("foreground").alias("foreground")
    )
    return out.withColumn("events_per_s", F.col("events") * F.lit(1e6 / window_us))


RATE_SHARES = {"events_per_s_p50": 0.5, "events_per_s_p95": 0.95}
TIME_SHARES = {"ms_p50": 0.5, "ms_p90": 0.9, "ms_p95": 0.95}


def rate_summary(rates: DataFrame) -> DataFrame:
    """One row per recording from ``window_rates``: windows, events, foreground and event rates."""
    totals = rates.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("events").alias("events"),
        F.sum("foreground").alias("foreground"),
        F.avg("events_per_s").alias("events_per_s"),
    )
    spread = index_percentiles(rates, ["stream_id"], "events_per_s", RATE_SHARES).drop("n")
    return totals.join(spread.withColumnRenamed("max", "events_per_s_max"), "stream_id", "left")


def run_summary(rates: DataFrame, updates: DataFrame, milliseconds: str, budget_ms: float) -> DataFrame:
    """``rate_summary`` with the updates' times: percentiles, maximum and missed deadlines.

    ``updates`` has one row per update; a recording without updates keeps its rates with null times.
    """
    keys = ["stream_id"]
    late = deadline_summary(updates, keys, milliseconds, budget_ms)
    spread = index_percentiles(updates, keys, milliseconds, TIME_SHARES).drop("n", "max")
    return rate_summary(rates).join(late, keys, "left").join(spread, keys, "left")


def flight_after(seconds: Column | float) -> g.Vec:
    """Filtered flight ``seconds`` later, in the stabilised orientation."""
    t = F.lit(seconds) if isinstance(seconds, (int, float)) else seconds
    axes = "xyz"
    return g.ballistic(
        tuple(F.col(f"stabilized_{a}_m") for a in axes),
        tuple(F.col(f"stabilized_v{a}_mps") for a in axes),
        tuple(F.col(f"down_{a}") * 9.81 for a in axes),
        t,
    )


def prediction_errors(tracks: DataFrame, poses: DataFrame, camera: CameraModel, step_us: int, mount=None) -> DataFrame:
    """Flight predicted 100 ms ahead against the outline measured then, in pixels.

    A self equi join on track and due update. ``poses`` gives the camera orientation at that time.
    """
    ahead = CHECK_US // step_us
    point = flight_after(CHECK_US * 1e-6)
    made = tracks.where("has_flight").select(
        "stream_id",
        "track_id",
        (F.col("window_id") + ahead).alias("window_id"),
        *[v.alias(f"p{a}") for v, a in zip(point, "xyz")],
    )
    seen = tracks.where("outline_supported and match_x_px is not null").select(
        "stream_id", "track_id", "window_id", "match_x_px", "match_y_px"
    )
    both = made.join(seen, ["stream_id", "track_id", "window_id"]).join(poses, ["stream_id", "window_id"])

    def orientation(prefix: str) -> g.Mat:
        return g.quaternion_matrix(tuple(F.col(prefix + n) for n in ("qw", "qx", "qy", "qz")))

    # Stabilised axes -> common orientation -> current camera axes.
    m = g.lit_matrix(mount or IDENTITY)
    common = g.rotate(orientation("s_"), g.rotate(g.transpose(m), tuple(F.col(f"p{a}") for a in "xyz")))
    shared = both.withColumns({f"c{a}": fence(v) for a, v in zip("xyz", common)})
    ray = g.rotate(m, g.rotate(g.transpose(orientation("")), tuple(F.col(f"c{a}") for a in "xyz")))
    placed = shared.withColumns({f"r{a}": fence(v) for a, v in zip("xyz", ray)})
    px, py = g.project(camera, tuple(F.col(f"r{a}") for a in "xyz"))
    return placed.select(
        "stream_id", "track_id", "window_id", F.hypot(px - F.col("match_x_px"), py - F.col("match_y_px")).alias("error_px")
    ).where("error_px is not null")


def flight_paths(tracks: DataFrame, ahead_s: float = 0.3) -> DataFrame:
    """The newest flight of each track, sampled from the track's start to ``ahead_s`` later."""
    flights = tracks.where("has_flight")
    numbers = [f"stabilized_{a}_m" for a in "xyz"] + [f"stabilized_v{a}_mps" for a in "xyz"] + [f"down_{a}" for a in "xyz"]
    newest = flights.groupBy("stream_id", "track_id").agg(
        F.min("time_s").alias("start_s"), F.max_by(F.struct("time_s", *numbers), "window_id").alias("f")
    )
    flat = newest.select("stream_id", "track_id", "start_s", "f.*")
    span = F.col("time_s") - F.col("start_s") + ahead_s
    steps = F.greatest(F.ceil(span / PATH_STEP_S), F.lit(1)).cast("int")
    sampled = flat.withColumns({"span": span, "steps": steps}).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("steps")))
    )
    at = F.col("start_s") - F.col("time_s") + F.col("span") * F.col("i") / F.col("steps")
    point = flight_after(at)
    return sampled.select(
        "stream_id", "track_id", "i", (F.col("time_s") + at).alias("path_s"), *[v.alias(f"{a}_m") for v, a in zip(point, "xyz")]
    )


def trail(tracks: DataFrame, x: str = "x_px", y: str = "y_px", span_us: int = TRAIL_US) -> DataFrame:
    """At every update the places measured in the last ``span_us``, in order of time, both ends included.

    ``points`` is an array of ``(at_us, x, y)``, empty when nothing was measured. Tracks do not matter:
    the trail runs on from one to the next.
    """
    at = F.round(F.col("time_s") * 1e6).cast("long")
    point = F.struct("at_us", F.col(x).alias("x"), F.col(y).alias("y"))
    places = {"points": F.when(F.col("state") == "measured", point)}
    held = recent_rows(tracks.withColumn("at_us", at), ["stream_id"], "at_us", span_us, places)
    return held.select("stream_id", "window_id", "at_us", F.sort_array("points").alias("points"))


def recent_median(df: DataFrame, keys: list[str], order: str, value: str, block: int, count: int = 5) -> DataFrame:
    """Upper median of the last ``count`` values at every row; ``block`` cuts the integer ``order``."""
    held = last_rows(df, keys, order, floor_div(F.col(order), block), count, {"recent": F.col(value)})
    middle = F.floor(F.size("recent") / 2).cast("int") + 1
    return held.withColumn("median", F.element_at(F.sort_array("recent"), middle)).drop("recent")
