"""Registered queries over the relational tables. Each takes (spark, folder) -> DataFrame."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumenflow.config import (
    BackgroundConfig,
    BallConfig,
    CameraModel,
    ClusterConfig,
    MotionConfig,
    ParabolaConfig,
    PolarityConfig,
    StaticConfig,
    TrackerConfig,
)
from lumenflow.deploy import ship
from lumenflow.operators import (
    alignment,
    ball,
    clusters,
    components,
    filters,
    foreground,
    imu,
    metrics,
    motion,
    outlines,
    panels,
    proposals,
    rolling,
    tracker,
)
from lumenflow.plans.hopping import explode_hops, hop_aggregate
from lumenflow.plans.lineage import materialise
from lumenflow.plans.scan import running
from lumenflow.sinks import tables
from lumenflow.sources.codec import decode_blocks, encode_blocks
from lumenflow.sources.evt import time_range as stream_time_range
from lumenflow.sources.imu import rebase
from lumenflow.sources.pixels import pixelised_events

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
#: The bridge table's sensor: columns and rows.
SENSOR = (24, 18)
WINDOW = ClusterConfig(window_us=6 * HOUR_US, step_us=6 * HOUR_US, cell_size=1, min_events=5, min_cells=3, circle_fit=False)
ROLLING = ClusterConfig(window_us=6 * HOUR_US, step_us=3 * HOUR_US, cell_size=1, min_events=5, min_cells=3)
BACKGROUND = BackgroundConfig(radius_px=2, window_us=HOUR_US)
STATIC = StaticConfig(cell_size=4, stable_after_us=DAY_US, min_events=8, inactive_after_us=8 * HOUR_US)


def load(spark: SparkSession, folder: str, **options) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return pixelised_events(spark, f"{folder}/events.parquet", **options)


def tumbling(events: DataFrame, window_us: int) -> DataFrame:
    return events.withColumn("window_id", F.floor(F.col("timestamp_us") / window_us).cast("long"))


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    kept = filters.polarity_filter(load(spark, folder), PolarityConfig("all"))
    return tumbling(kept, WINDOW.window_us)


WINDOW_KEYS = ["stream_id", "window_id"]


def polarity_filter(spark, folder):
    return filters.polarity_filter(load(spark, folder), PolarityConfig("positive"))


def background_filter(spark, folder):
    return filters.background_filter(load(spark, folder), BACKGROUND)


def static_filter(spark, folder):
    return filters.static_flags(load(spark, folder), STATIC)


def static_removed(spark, folder):
    """What the static filter lets through."""
    flagged = static_filter(spark, folder)
    return flagged.where(~F.col("is_static")).drop("is_static")


def static_cleanup(spark, folder):
    return filters.cleanup_instants(load(spark, folder), STATIC.inactive_after_us)


def filter_chain(spark, folder):
    accept = filters.configured(
        PolarityConfig("negative"), BACKGROUND, StaticConfig(4, DAY_US, 10, None)
    )
    return accept(load(spark, folder))


def cell_counts(spark, folder):
    return clusters.count_cells(_windows(spark, folder), WINDOW_KEYS, 2)


def window_components(spark, folder):
    return clusters.window_clusters(_windows(spark, folder), WINDOW_KEYS, WINDOW, SENSOR)


def tiled_components(spark, folder):
    """The same components from 8 x 8 tiles that are stitched at their borders."""
    cells = clusters.count_cells(_windows(spark, folder), WINDOW_KEYS, 1)
    return clusters.merge_cells(
        components.connected_cells(cells, WINDOW_KEYS, tile=8), WINDOW_KEYS
    )


def best_cluster(spark, folder):
    every = clusters.window_clusters(_windows(spark, folder), WINDOW_KEYS, WINDOW, SENSOR)
    return clusters.best_cluster(every, WINDOW_KEYS, WINDOW).withColumn(
        "confidence", F.round("confidence", 6)
    )


def daily_best_cluster(spark, folder):
    """Best cluster per day on 2 x 2 pixel cells."""
    cfg = replace(WINDOW, window_us=DAY_US, step_us=DAY_US, cell_size=2)
    events = tumbling(load(spark, folder), DAY_US)
    every = clusters.window_clusters(events, WINDOW_KEYS, cfg, SENSOR)
    return clusters.best_cluster(every, WINDOW_KEYS, cfg).withColumn("confidence", F.round("confidence", 6))


def rolling_ticks(spark, folder):
    return rolling.rolling_ticks(load(spark, folder), ROLLING)


def rolling_members(spark, folder):
    members = rolling.rolling_members(load(spark, folder), ROLLING)
    return members.groupBy("stream_id", "tick", "tick_us").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


def rolling_ideal(spark, folder):
    members = rolling.rolling_members(load(spark, folder), ROLLING, mode="ideal")
    return members.groupBy("stream_id", "tick", "tick_us").agg(F.count(F.lit(1)).alias("n"))


def rolling_detections(spark, folder):
    return rolling.rolling_detections(load(spark, folder), ROLLING, SENSOR)


# ---- windows, panels, summaries ----------------------------------------------------------------

#: Small lens model for the bridge sensor.
LENS = CameraModel(20.0, 21.0, 12.0, 9.0, (-0.07, 0.11, -0.0003, -0.0002, -0.07)).for_sensor(*SENSOR)
PINHOLE = CameraModel(20.0, 21.0, 12.0, 9.0).for_sensor(*SENSOR)
#: The log's time divided by this, so that 30 days become 26 seconds.
SHRINK = 100_000
MOTION = MotionConfig(window_us=300_000, step_us=100_000, cell_px=3, min_events=3, min_component_cells=2)
MOTION_KEYS = ["stream_id", "window_id"]


def shrunk(spark, folder, factor=SHRINK, **options) -> DataFrame:
    """The pixelised log on a sensor's time scale, counted from its first event's slot."""
    events = load(spark, folder, **options)
    return events.withColumn("timestamp_us", F.floor(F.col("timestamp_us") / factor).cast("long"))


def pixel_mask(spark, folder):
    return filters.mask_pixels(load(spark, folder), [(0, 0), (7, 3), (23, 17), (12, 9)])


def clip_range(spark, folder):
    start = 1_704_067_200_000_000 + 3 * DAY_US
    end = start + 5 * DAY_US
    return filters.clip_range(load(spark, folder, since_us=start, until_us=end), start, end)


def accepted_flags(spark, folder):
    accept = filters.configured(PolarityConfig("positive"), BACKGROUND)
    return filters.accepted_flags(load(spark, folder), accept)


def evenly_spaced(spark, folder):
    daily = tumbling(load(spark, folder), DAY_US)
    return outlines.evenly_spaced(daily, WINDOW_KEYS, ["seq"], 10).select(*WINDOW_KEYS, "seq")


def cluster_proposals(spark, folder):
    """Up to six clusters per six-hour window, each search without the boxes found before."""
    pixels = _windows(spark, folder).groupBy(*WINDOW_KEYS, "x", "y").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )
    limits = proposals.ProposalLimits(cell_px=1, min_events=5)
    return proposals.propose(pixels, limits)


def comparison_panels(spark, folder):
    rows = _still_rows(spark, folder).withColumns(
        {
            "ox": F.col("px"),
            "oy": F.col("py"),
            "foreground_off": F.col("polarity"),
            "foreground_on": ~F.col("polarity"),
        }
    )
    return panels.comparison_panels(rows, MOTION_KEYS, *SENSOR)


def hop_counts(spark, folder):
    events = load(spark, folder)
    counts = {"n": (F.count(F.lit(1)), "sum"), "positive": (F.count_if("polarity"), "sum")}
    return hop_aggregate(events, ["stream_id"], F.col("timestamp_us"), WINDOW.window_us, 2 * HOUR_US, counts)


def density_panel(spark, folder):
    return panels.density_panel(_windows(spark, folder), WINDOW_KEYS, *SENSOR)


def pixel_last_color(spark, folder):
    events = load(spark, folder)
    accepted = filters.background_flags(events, BACKGROUND).withColumnRenamed("supported", "accepted")
    return panels.polarity_raster(tumbling(accepted, DAY_US), WINDOW_KEYS, *SENSOR)


def time_range(spark, folder):
    return stream_time_range(load(spark, folder))


def topn_detections(spark, folder):
    return best_cluster(spark, folder).orderBy("window_id").limit(25)


def index_percentile(spark, folder):
    events = load(spark, folder, with_value=True)
    return metrics.index_percentiles(
        events, ["polarity"], "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95}
    )


def recent_median(spark, folder):
    sized = best_cluster(spark, folder).withColumn("size", F.col("max_x") - F.col("min_x") + 1)
    return metrics.recent_median(sized, ["stream_id"], "window_id", "size", block=1 << 16).select(
        "stream_id", "window_id", "size", "median"
    )


def deadline_misses(spark, folder):
    events = load(spark, folder, with_value=True)
    return metrics.deadline_summary(tumbling(events, DAY_US), WINDOW_KEYS, "value", 10.0)


def run_summary(spark, folder):
    """Rates of every sensor in six-hour windows, and its log values read as update times."""
    log = load(spark, folder, with_value=True, sensors=SENSORS)
    rows = tumbling(log, WINDOW.window_us).withColumn("foreground", F.col("polarity"))
    rates = metrics.window_rates(rows, WINDOW_KEYS, WINDOW.window_us)
    found = metrics.run_summary(materialise(rates), log, "value", 10.0)
    return found.withColumns({c: F.round(c, 9) for c in found.columns if c.startswith("events_per_s")})


def recent_events(spark, folder):
    """What a view of each window would still show: the last 10 ms."""
    rows = _still_rows(spark, folder).withColumn("foreground", F.col("polarity"))
    return tables.recent_events(rows)


# ---- positions --------------------------------------------------------------------------------

BALL = BallConfig(0.07, LENS, "bbox_average")
PARABOLA = ParabolaConfig(LENS, ball_diameter_m=0.5, inlier_threshold_m=1.0, buffer_len=8)


def _spaced(detections: DataFrame) -> DataFrame:
    """Detections on a 50 ms grid, in the order of their windows."""
    return detections.withColumn("timestamp_us", F.col("window_id") * 50_000)


def ball_depth(spark, folder):
    found = ball.ball_measurements(_spaced(best_cluster(spark, folder)), BALL)
    return found.select(
        "stream_id", "window_id", "pixel_diameter", *[F.round(c, 9).alias(c) for c in ("x_m", "y_m", "z_m")]
    )


def bbox_depth(spark, folder):
    found = ball.parabola_points(_spaced(best_cluster(spark, folder)), PARABOLA)
    return found.select(
        "stream_id", "window_id", *[F.round(c, 6).alias(c) for c in ("pixel_area", "x_m", "y_m", "z_m")]
    )


def smoothed_path(spark, folder):
    detections = clusters.best_cluster(
        clusters.window_clusters(_windows(spark, folder), WINDOW_KEYS, WINDOW, SENSOR), WINDOW_KEYS, WINDOW
    )
    path = ball.smooth_path(ball.ball_measurements(_spaced(detections), BALL))
    kept = ("stream_id", "timestamp_us", "pixel_diameter")
    return path.select(*kept, *[F.round(c, 9).alias(c) for c in path.columns if c not in kept])


def parabola_fit(spark, folder):
    points = ball.parabola_points(_spaced(best_cluster(spark, folder)), PARABOLA)
    return ball.parabola_fits(points, PARABOLA).select("stream_id", "window_id", "fit.*")


def undistort(spark, folder):
    from lumenflow.functions.geometry import undistort as rays

    events = load(spark, folder)
    placed = rays(events, LENS, F.col("x").cast("double"), F.col("y").cast("double"))
    return placed.select("seq", F.round("ray_x", 8).alias("ray_x"), F.round("ray_y", 8).alias("ray_y"))


# ---- motion -----------------------------------------------------------------------------------


def samples_of(events: DataFrame, axis: str | None = None) -> DataFrame:
    """One inertial sample per log row, turning by its value; ``axis`` keeps a single axis."""
    rate = {
        "gx": (F.pmod(F.col("value"), F.lit(1.0)) - 0.5) * 0.4,
        "gy": (F.pmod(F.col("value") / 10, F.lit(1.0)) - 0.5) * 0.4,
        "gz": (F.pmod(F.col("value") / 100, F.lit(1.0)) - 0.5) * 0.4,
    }
    raw = events.select(
        "stream_id",
        (F.col("timestamp_us") * 1e-6).alias("time_s"),
        *[(v if axis in (None, n) else F.lit(0.0)).alias(n) for n, v in rate.items()],
        F.lit(0.0).alias("gravity_x"),
        F.lit(1.0).alias("gravity_y"),
        F.lit(0.0).alias("gravity_z"),
        F.col("seq").alias("__row"),
    )
    return rebase(raw, has_gravity=True)


def imu_bracket(spark, folder):
    """Interpolated turn rate in the middle of every 10 ms of the recording."""
    events = materialise(shrunk(spark, folder, with_value=True))
    intervals = imu.prepared_imu(samples_of(events))
    slots = events.select("stream_id", F.floor(F.col("timestamp_us") / 10_000).alias("slot")).distinct()
    first = events.groupBy("stream_id").agg(F.min("timestamp_us").alias("first_us"))
    points = slots.join(first, "stream_id").select(
        "stream_id", "slot", ((F.col("slot") * 10_000 + 5_000) * 1e-6 - F.col("first_us") * 1e-6).alias("time_s")
    )
    found = imu.gyro_at(points, intervals)
    return found.select("slot", *[F.round(n, 8).alias(n) for n in ("gx", "gy", "gz")])


def _motion_rows(spark, folder, axis: str | None = "gy"):
    events = materialise(shrunk(spark, folder, with_value=True))
    intervals = imu.prepared_imu(samples_of(events, axis))
    windows = materialise(motion.window_grid(motion.time_bounds(events), intervals, MOTION))
    rotations = materialise(motion.window_rotations(windows, intervals, MOTION))
    rows = motion.window_events(events.drop("value"), windows, MOTION)
    return motion.compensate(rows, rotations, PINHOLE, with_original=True)


def compensated_points(spark, folder):
    """Every event of every motion window, turned into the window's last orientation."""
    return _motion_rows(spark, folder).select(
        "window_id", "seq", "covered", F.round("px", 4).alias("px"), F.round("py", 4).alias("py")
    )


def motion_foreground(spark, folder):
    """Foreground per window without and with compensation, and both focus values."""
    return _foreground_table(_motion_rows(spark, folder, axis=None))


def turned_foreground(spark, folder):
    """The same for a camera that turns about one axis."""
    rounded = {name: F.round(name, 6) for name in ("focus_off", "focus_on")}
    return _foreground_table(_motion_rows(spark, folder)).withColumns(rounded)


def _foreground_table(rows: DataFrame) -> DataFrame:
    rows = materialise(rows.select(*MOTION_KEYS, "timestamp_us", "start_us", "end_us", "ox", "oy", "px", "py"))
    marked = foreground.segment(rows, MOTION_KEYS, PINHOLE, MOTION, "ox", "oy", "foreground_off")
    marked = foreground.segment(marked, MOTION_KEYS, PINHOLE, MOTION, "px", "py", "foreground_on")
    counts = marked.groupBy(*MOTION_KEYS).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("foreground_off").alias("foreground_off"),
        F.count_if("foreground_on").alias("foreground_on"),
    )
    off = foreground.focus(rows, MOTION_KEYS, *SENSOR, "ox", "oy").withColumnRenamed("focus", "focus_off")
    on = foreground.focus(rows, MOTION_KEYS, *SENSOR).withColumnRenamed("focus", "focus_on")
    return counts.join(off, MOTION_KEYS, "left").join(on, MOTION_KEYS, "left")


def _still_rows(spark, folder) -> DataFrame:
    """Hopping windows over the unturned events: end every 100 ms, 300 ms long."""
    events = shrunk(spark, folder)
    hops = explode_hops(events, F.col("timestamp_us"), MOTION.window_us, MOTION.step_us)
    return hops.withColumns(
        {
            "end_us": F.col("window_id") * MOTION.step_us,
            "start_us": F.col("window_id") * MOTION.step_us - MOTION.window_us,
            "px": F.col("x").cast("double"),
            "py": F.col("y").cast("double"),
        }
    )


def foreground_cells(spark, folder):
    cells = foreground.motion_cells(_still_rows(spark, folder), MOTION_KEYS, PINHOLE, MOTION)
    scored = foreground.late_cells(cells, MOTION_KEYS, MOTION)
    return scored.select(
        *MOTION_KEYS, "cx", "cy", "n", "early", F.round("mean_age", 8).alias("mean_age"), F.round("window_age", 8).alias("window_age")
    )


def foreground_keep(spark, folder):
    cells = foreground.motion_cells(_still_rows(spark, folder), MOTION_KEYS, PINHOLE, MOTION)
    return foreground.foreground_regions(cells, MOTION_KEYS, PINHOLE, MOTION).select(
        *MOTION_KEYS, "cx", "cy", "label", "size", "new_cells", "early_support", "keep"
    )


def focus_energy(spark, folder):
    energy = foreground.focus(_still_rows(spark, folder), MOTION_KEYS, *SENSOR, scale=4)
    return energy.withColumn("focus", F.round("focus", 6))


def canvas(spark, folder):
    rows = _still_rows(spark, folder).withColumn("foreground", F.col("polarity"))
    return panels.foreground_canvas(rows, MOTION_KEYS, *SENSOR)


def calib_windows(spark, folder):
    return alignment.calibration_windows(shrunk(spark, folder), min_events=5).select(
        "stream_id", "slot", "rank", "seq", "timestamp_us", "x", "y"
    )


# ---- tracking ---------------------------------------------------------------------------------

TRACKER = TrackerConfig(0.07)
TRACK_CAMERA = CameraModel(500.0, 500.0, 320.0, 240.0).for_sensor(640, 480)
TRACK_MOTION = MotionConfig()


def ring_scene(events: DataFrame) -> DataFrame:
    """Every log row as one sensor event: a ring of 20 px that crosses a 640 x 480 view again and
    again, and a quarter of the rows on flickering static edges."""
    us = F.col("seq") * 25
    centre = F.lit(100.0) + F.pmod(us, F.lit(600_000)) * 800e-6
    angle = F.pmod(F.col("seq") * 0.6180339887 + F.col("value"), F.lit(1.0)) * 6.283185307179586
    edge = F.col("seq") % 4 == 0
    k = F.floor(F.col("seq") / 4)
    return events.select(
        "stream_id",
        "seq",
        us.alias("timestamp_us"),
        F.when(edge, F.element_at(F.array(*[F.lit(v) for v in (40, 41, 600, 601)]), (k % 4 + 1).cast("int")))
        .otherwise(F.round(centre + F.cos(angle) * 20).cast("int"))
        .alias("x"),
        F.when(edge, (F.lit(30) + (F.floor(k / 4) % 35) * 12).cast("int"))
        .otherwise(F.round(F.lit(200.0) + F.sin(angle) * 20).cast("int"))
        .alias("y"),
        "polarity",
    )


def _still_samples(scene: DataFrame) -> DataFrame:
    """A still inertial sample every 10 ms of the scene."""
    raw = scene.where(F.col("seq") % 400 == 0).select(
        "stream_id",
        (F.col("timestamp_us") * 1e-6).alias("time_s"),
        *[F.lit(0.0).alias(n) for n in ("gx", "gy", "gz", "gravity_x")],
        F.lit(1.0).alias("gravity_y"),
        F.lit(0.0).alias("gravity_z"),
        F.col("seq").alias("__row"),
    )
    return rebase(raw, has_gravity=True)


def ball_track(spark, folder):
    """The whole tracker, from events to filtered flight."""
    scene = materialise(ring_scene(load(spark, folder, with_value=True)))
    return tracker.track_ball(scene, _still_samples(scene), TRACK_CAMERA, TRACK_MOTION, TRACKER)


def outline_candidates(spark, folder):
    """Cluster proposals and their outlines in every tracker window."""
    scene = materialise(ring_scene(load(spark, folder, with_value=True)))
    intervals = imu.prepared_imu(_still_samples(scene))
    windows = materialise(motion.window_grid(rolling.stream_bounds(scene), intervals, TRACK_MOTION))
    return tracker.window_candidates(scene, windows, intervals, TRACK_CAMERA, TRACK_MOTION)


def alignment_scores(spark, folder):
    """Focus gain of all axis mappings at three offsets, on calibration windows of the log."""
    events = materialise(shrunk(spark, folder, with_value=True))
    intervals = imu.prepared_imu(samples_of(events))
    wide = events.select(
        "stream_id", "seq", "timestamp_us", (F.col("x") * 25 + 20).alias("x"), (F.col("y") * 26 + 10).alias("y"), "polarity"
    )
    samples = materialise(alignment.calibration_windows(wide, min_events=5))
    rays, baseline = alignment.fit_points(samples, TRACK_CAMERA)
    trials = alignment.every_pair([-0.1, 0.0, 0.1], alignment.proper_mounts())
    return alignment.score(trials, rays, baseline, intervals, TRACK_CAMERA)


#: Sensors that the log's users are dealt over, and the windows of their updates: half a day, every hour.
SENSORS = 3
UPDATE = replace(WINDOW, window_us=12 * HOUR_US, step_us=HOUR_US, min_events=8)
#: Seconds between two updates, and updates without a detection before a track is lost.
UPDATE_S = 0.05
HOLD = 2


def _sensor_clusters(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Every sensor's events, and the eligible clusters found in each of their windows."""
    log = load(spark, folder, with_value=True, sensors=SENSORS)
    found = clusters.hopping_clusters(log, F.col("timestamp_us"), UPDATE, SENSOR)
    return log, materialise(clusters.eligible(found, UPDATE))


def _grid(detections: DataFrame) -> DataFrame:
    """All windows of a stream from its first detection to its last."""
    span = detections.groupBy("stream_id").agg(F.min("window_id").alias("a"), F.max("window_id").alias("b"))
    return span.select("stream_id", F.explode(F.sequence("a", "b")).alias("window_id"))


def _turns(events: DataFrame) -> DataFrame:
    """How far a sensor is turned in a window, by the mean value of its events."""
    parts = {"value": (F.sum("value"), "sum"), "n": (F.count("value"), "sum")}
    sums = hop_aggregate(events, ["stream_id"], F.col("timestamp_us"), UPDATE.window_us, UPDATE.step_us, parts)
    return sums.select(*WINDOW_KEYS, (F.col("value") / F.col("n") / 100).alias("turn"))


def _logged_track(spark, folder):
    """The best cluster of every window as a ball, held through short gaps.

    A window without one is predicted up to ``HOLD`` windows after the last, then lost; the next
    detection after a loss opens a track. Flight is the straight line between two detections of a track.
    """
    events, found = _sensor_clusters(spark, folder)
    best = clusters.best_cluster(found, WINDOW_KEYS, UPDATE)
    seen = ball.ball_measurements(best, replace(BALL, camera=PINHOLE))
    rows = _grid(seen).join(seen, WINDOW_KEYS, "left").join(_turns(events), WINDOW_KEYS, "left")
    rows = rows.withColumn("hit", F.col("event_count").isNotNull())
    block = F.shiftright("window_id", 16)
    here = F.struct("window_id", "x_m", "y_m", "z_m")
    held = running(
        materialise(rows), ["stream_id"], "window_id", block, last={"before": F.when(F.col("hit"), here)}
    ).withColumn("age", F.col("window_id") - F.col("before.window_id"))
    opens = F.col("hit") & F.coalesce(F.col("age") > HOLD + 1, F.lit(True))
    numbered = running(
        materialise(held.withColumn("opens", opens)), ["stream_id"], "window_id", block,
        total={"track_id": F.col("opens").cast("long")}, include_current=True,
    )
    flies = F.col("hit") & ~F.col("opens")
    tracks = numbered.select(
        *WINDOW_KEYS,
        "track_id",
        (F.col("window_id") * UPDATE_S).alias("time_s"),
        F.when(F.col("hit"), "measured").when(F.col("age") <= HOLD, "predicted").otherwise("lost").alias("state"),
        F.coalesce(F.col("event_count") >= 12, F.lit(False)).alias("outline_supported"),
        flies.alias("has_flight"),
        "z_m",
        F.col("centroid_x").alias("match_x_px"),
        F.col("centroid_y").alias("match_y_px"),
        *[F.when(flies, F.col(f"{a}_m")).alias(f"stabilized_{a}_m") for a in "xyz"],
        *[
            F.when(flies, (F.col(f"{a}_m") - F.col(f"before.{a}_m")) / (F.col("age") * UPDATE_S)).alias(f"stabilized_v{a}_mps")
            for a in "xyz"
        ],
        F.sin("turn").alias("down_x"),
        F.cos("turn").alias("down_y"),
        F.lit(0.0).alias("down_z"),
    )
    return tracks, events


def _turned_poses(events: DataFrame) -> DataFrame:
    """A camera turned about its vertical axis, seen from axes that are turned about the optical one."""
    zero = F.lit(0.0)
    half, quarter = F.col("turn") / 2, F.col("turn") / 4
    axes = {
        "qw": F.cos(quarter), "qx": zero, "qy": F.sin(quarter), "qz": zero,
        "s_qw": F.cos(half), "s_qx": zero, "s_qy": zero, "s_qz": F.sin(half),
    }
    return _turns(events).select(*WINDOW_KEYS, *[v.alias(n) for n, v in axes.items()])


def associated_tracks(spark, folder):
    """The tracker's association and flight over all clusters of every window, in a 640 x 480 view.

    A row of the log counts as ten sensor events, so that clusters are as dense as a ball's edge.
    """
    events, found = _sensor_clusters(spark, folder)
    order = Window.partitionBy(*WINDOW_KEYS).orderBy(F.desc("event_count"), "label")
    width = (F.col("max_x") - F.col("min_x") + 1) * 5.0
    height = (F.col("max_y") - F.col("min_y") + 1) * 5.0
    candidates = found.select(
        *WINDOW_KEYS,
        F.row_number().over(order).alias("rank"),
        (F.col("centroid_x") * 25 + 20).alias("x"),
        (F.col("centroid_y") * 26 + 10).alias("y"),
        width.alias("width"),
        height.alias("height"),
        (F.col("event_count") * 10).alias("events"),
        F.when(F.col("event_count") >= 12, F.struct(((width + height) / 4).alias("radius"))).alias("outline"),
    )
    first = F.min("window_id").over(Window.partitionBy("stream_id"))
    windows = _grid(found).withColumn("at", F.col("window_id") - first).select(
        *WINDOW_KEYS, F.lit(0).cast("long").alias("origin_us"), (F.col("at") * TRACK_MOTION.step_us).alias("end_us")
    )
    turn = F.col("turn")
    poses = _turned_poses(events).join(_turns(events), WINDOW_KEYS).select(
        *WINDOW_KEYS, F.lit(0).alias("gap_count"), F.lit(0).alias("gap_floor"),
        "qw", "qx", "qy", "qz", "s_qw", "s_qx", "s_qy", "s_qz", F.lit(1).cast("long").alias("stabilized_frame"),
        F.sin(turn).alias("gravity_x"), F.cos(turn).alias("gravity_y"), F.lit(0.0).alias("gravity_z"),
    )
    return tracker.track(windows, poses, candidates, TRACK_CAMERA, TRACK_MOTION, TRACKER)


def _rounded(df: DataFrame, *exact: str) -> DataFrame:
    return df.select(*exact, *[F.round(c, 6).alias(c) for c in df.columns if c not in exact])


def track_summary(spark, folder):
    exact = ("stream_id", "track_id", "measured", "outlines")
    return _rounded(metrics.track_summary(_logged_track(spark, folder)[0]), *exact)


def track_states(spark, folder):
    return metrics.state_counts(_logged_track(spark, folder)[0], ["stream_id"])


def track_trail(spark, folder):
    """How many places the trail of each update holds, its ends in time (-1 without any) and its middle."""
    places = metrics.trail(_logged_track(spark, folder)[0], "match_x_px", "match_y_px")
    shown = places.select(
        *WINDOW_KEYS,
        F.size("points").cast("long").alias("places"),
        *[F.coalesce(f("points.at_us"), F.lit(-1)).alias(n) for n, f in (("oldest_us", F.array_min), ("newest_us", F.array_max))],
        *[
            (F.aggregate(f"points.{a}", F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size("points"), F.lit(0))).alias(f"mean_{a}")
            for a in "xy"
        ],
    )
    return _rounded(shown, *WINDOW_KEYS, "places", "oldest_us", "newest_us")


def prediction_errors(spark, folder):
    tracks, events = _logged_track(spark, folder)
    errors = metrics.prediction_errors(tracks, _turned_poses(events), PINHOLE, round(UPDATE_S * 1e6))
    return _rounded(errors, "stream_id", "track_id", "window_id")


def measured_segments(spark, folder):
    segments = metrics.measured_segments(_logged_track(spark, folder)[0])
    return _rounded(segments, "stream_id", "track_id", "updates")


def segment_lines(spark, folder):
    """One JSON line per track with its measured segments, times in milliseconds."""
    segments = metrics.measured_segments(_logged_track(spark, folder)[0])
    whole = {c: F.round(F.col(c) * 1000).cast("long") for c in ("start_s", "end_s")}
    return tables.segments_json(segments.withColumns(whole))


def flight_paths(spark, folder):
    return _rounded(metrics.flight_paths(_logged_track(spark, folder)[0]), "stream_id", "track_id", "i")


# ---- packed words -----------------------------------------------------------------------------


def _codec(spark, folder, fmt):
    events = shrunk(spark, folder)
    return decode_blocks(encode_blocks(events, fmt), fmt)


def evt2_decode(spark, folder):
    return _codec(spark, folder, "evt2")


def evt21_decode(spark, folder):
    return _codec(spark, folder, "evt21")


def evt3_decode(spark, folder):
    return _codec(spark, folder, "evt3")


QUERIES = {
    f.__name__: f
    for f in (
        best_cluster,
        daily_best_cluster,
        polarity_filter,
        background_filter,
        static_filter,
        static_removed,
        static_cleanup,
        filter_chain,
        cell_counts,
        window_components,
        tiled_components,
        rolling_ticks,
        rolling_members,
        rolling_ideal,
        rolling_detections,
        pixel_mask,
        clip_range,
        accepted_flags,
        evenly_spaced,
        cluster_proposals,
        comparison_panels,
        hop_counts,
        density_panel,
        pixel_last_color,
        time_range,
        topn_detections,
        index_percentile,
        recent_median,
        deadline_misses,
        run_summary,
        recent_events,
        ball_depth,
        bbox_depth,
        smoothed_path,
        parabola_fit,
        undistort,
        imu_bracket,
        compensated_points,
        motion_foreground,
        turned_foreground,
        foreground_cells,
        foreground_keep,
        focus_energy,
        canvas,
        calib_windows,
        ball_track,
        outline_candidates,
        alignment_scores,
        associated_tracks,
        track_summary,
        track_states,
        track_trail,
        prediction_errors,
        flight_paths,
        measured_segments,
        segment_lines,
        evt2_decode,
        evt21_decode,
        evt3_decode,
    )
}
