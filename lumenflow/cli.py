"""Command line: ``python -m lumenflow.cli <recording> track-ball|motion-compare|ball-3d [options]``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumenflow.config import (
    BackgroundConfig,
    ClusterConfig,
    InvalidConfig,
    MotionConfig,
    ParabolaConfig,
    PolarityConfig,
    StaticConfig,
    TrackerConfig,
    default_camera,
)
from lumenflow.deploy import ship
from lumenflow.operators import alignment, ball, filters, foreground, metrics, motion, panels, rolling, tracker
from lumenflow.operators.imu import prepared_imu
from lumenflow.plans.lineage import materialise
from lumenflow.sinks import tables, text
from lumenflow.sources import evt
from lumenflow.sources.calibration import parse_pixel_mask, read_calibration
from lumenflow.sources.imu import imu_of_recordings, read_imu_csv, still_imu

COMMANDS = ("track-ball", "motion-compare", "ball-3d")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenflow", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("recording")
    common.add_argument("--format", default="auto")
    common.add_argument("--endian", default="little")
    common.add_argument("--unwrap", action="store_true", help="continue time across the 24-bit wrap")
    common.add_argument("--mask-pixels", help="x:y,x:y pixels to drop")
    common.add_argument("--output", help="folder for the result table")

    track = sub.add_parser("track-ball", parents=[common])
    for name, kind, value in (
        ("window-us", int, 20_000), ("step-us", int, 5_000), ("cell-size", int, 2), ("min-events", int, 20),
        ("min-cells", int, 3), ("max-bbox-width", int, 200), ("max-bbox-height", int, 200),
        ("circle-tolerance-px", float, 2.5), ("max-detections", int, None),
        ("parabola-ball-diameter-m", float, 0.067),
    ):
        track.add_argument(f"--{name}", type=kind, default=value)
    track.add_argument("--no-circle-fit", action="store_true")
    track.add_argument("--polarity", default="all")
    track.add_argument("--raw-polarity", action="store_true")
    track.add_argument("--filter-background-activity", action="store_true")
    track.add_argument("--filter-static", action="store_true")
    background, static = BackgroundConfig(), StaticConfig()
    for name, value in (
        ("background-radius-px", background.radius_px), ("background-window-us", background.window_us),
        ("background-cleanup-after-us", background.cleanup_after_us), ("static-cell-size", static.cell_size),
        ("static-stable-after-us", static.stable_after_us), ("static-min-events", static.min_events),
        ("static-inactive-after-us", static.inactive_after_us),
    ):
        track.add_argument(f"--{name}", type=int, default=value)
    track.add_argument("--parabola-fit", action="store_true")
    track.add_argument("--calibration")

    moving = argparse.ArgumentParser(add_help=False)
    moving.add_argument("--imu", help="CSV; without it the camera stands still")
    moving.add_argument("--calibration", default="calibration.json")
    moving.add_argument("--alignment")
    moving.add_argument("--save-alignment")
    moving.add_argument("--auto-align", action="store_true")
    moving.add_argument("--alignment-range", type=float, default=4.0)
    moving.add_argument("--motion-offset", type=float)
    moving.add_argument("--imu-to-camera", help="nine comma separated numbers")
    moving.add_argument("--start-s", type=float)
    moving.add_argument("--end-s", type=float)
    for name, kind, value in (
        ("window-ms", float, 30.0), ("cell-px", int, 3), ("threshold", float, 0.12),
        ("min-cells", int, 8), ("min-new-fraction", float, 0.1),
    ):
        moving.add_argument(f"--motion-{name}", type=kind, default=value)
    sub.add_parser("motion-compare", parents=[common, moving])
    three = sub.add_parser("ball-3d", parents=[common, moving])
    three.add_argument("--ball-diameter-m", type=float, required=True)
    three.add_argument("--seek-s", type=float, help="only the updates shortly before this time and up to it")
    three.add_argument("--tracks-csv")
    three.add_argument("--segments-json", help="folder for one JSON line per track")
    return p


def recordings(args) -> list[str]:
    """Stream names of the recording, or of all recordings of a folder."""
    return [name.rsplit("/", 1)[-1] for name, _ in evt.list_files(args.recording)]


def sensor_size(headers: DataFrame) -> tuple[int, int]:
    """The size that all recordings of a run share; 1280 x 720 where a header has none."""

    def known(name: str, usual: int):
        return F.when(F.col(name) > 0, F.col(name)).otherwise(usual)

    sizes = headers.select(known("width", 1280), known("height", 720)).distinct().take(2)
    if len(sizes) != 1:
        raise InvalidConfig("recording", "one run needs recordings of one sensor size")
    return tuple(sizes[0])


def load_events(spark: SparkSession, args) -> tuple[DataFrame, tuple[int, int]]:
    """Decoded once into the shared folder; every later stage reads columns from there."""
    sensor = sensor_size(evt.header_table(spark, args.recording))
    events = evt.read_events(spark, args.recording, args.unwrap, format=args.format, endian=args.endian)
    if args.mask_pixels:
        events = filters.mask_pixels(events, parse_pixel_mask(args.mask_pixels, *sensor))
    return materialise(events), sensor


def track_ball(spark: SparkSession, args) -> DataFrame:
    events, sensor = load_events(spark, args)
    accept = filters.configured(
        PolarityConfig(args.polarity, not args.raw_polarity),
        BackgroundConfig(args.background_radius_px, args.background_window_us, args.background_cleanup_after_us)
        if args.filter_background_activity
        else None,
        StaticConfig(
            args.static_cell_size, args.static_stable_after_us, args.static_min_events, args.static_inactive_after_us
        )
        if args.filter_static
        else None,
    )
    cfg = ClusterConfig(
        args.window_us, args.step_us, args.cell_size, args.min_events, args.min_cells,
        args.max_bbox_width, args.max_bbox_height, not args.no_circle_fit, args.circle_tolerance_px,
    )
    found = rolling.rolling_detections(materialise(accept(events)), cfg, sensor)
    if args.parabola_fit:
        camera = read_calibration(args.calibration) if args.calibration else default_camera(*sensor)
        fit = ParabolaConfig(camera, ball_diameter_m=args.parabola_ball_diameter_m)
        points = ball.parabola_points(found, fit)
        fits = ball.parabola_fits(points, fit, order="timestamp_us")
        found = found.join(fits.select("stream_id", "tick", "fit"), ["stream_id", "tick"], "left")
    if args.max_detections:
        order = Window.partitionBy("stream_id").orderBy("timestamp_us", "tick")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= args.max_detections)
    return text.detection_lines(found, with_fit=args.parabola_fit)


def motion_inputs(spark: SparkSession, args) -> list[tuple]:
    """Events, camera, inertial intervals and settings; later alignment sources win.

    One part for all recordings, or one for each where every recording's alignment is searched.
    """
    events, sensor = load_events(spark, args)
    camera = read_calibration(args.calibration).for_sensor(*sensor)
    if not filters.time_decreases(events).isEmpty():
        raise InvalidConfig("recording", "time goes backwards; use --unwrap")
    names = recordings(args)
    if not args.imu:
        imu = still_imu(evt.time_range(events))
    elif len(names) == 1:
        # The samples belong to the one recording, whatever their file is called.
        imu = read_imu_csv(spark, args.imu, stream_id=names[0])
    else:
        imu = imu_of_recordings(materialise(read_imu_csv(spark, args.imu)), materialise(evt.time_range(events)))
    intervals = prepared_imu(imu)
    offset, mount = 0.0, MotionConfig().mount
    if args.alignment:
        offset, mount = text.read_alignment(args.alignment)
    if args.motion_offset is not None:
        offset = args.motion_offset
    if args.imu_to_camera:
        mount = text.check_mount([float(v) for v in args.imu_to_camera.split(",")])
    manual = args.alignment or args.motion_offset is not None or args.imu_to_camera
    cfg = MotionConfig(
        offset, mount, args.motion_cell_px, args.motion_threshold,
        min_component_cells=args.motion_min_cells, min_new_fraction=args.motion_min_new_fraction,
        window_us=round(args.motion_window_ms * 1000),
        step_us=10_000 if args.command == "ball-3d" else round(args.motion_window_ms * 1000),
    )
    if not (args.imu and (args.auto_align or not manual)):
        return [(events, camera, intervals, cfg)]
    parts = []
    for name in names:
        own = [table if len(names) == 1 else table.where(F.col("stream_id") == name) for table in (events, intervals)]
        try:
            found = alignment.auto_align(*own, camera, offset, args.alignment_range)
        except InvalidConfig as error:
            if len(names) == 1:
                raise
            raise InvalidConfig("alignment", f"of {name}: {error}") from error
        if args.save_alignment:
            text.write_alignment(found, args.save_alignment if len(names) == 1 else f"{args.save_alignment}.{name}")
        parts.append((own[0], camera, own[1], replace(cfg, offset_s=found.offset_s, mount=found.mount)))
    return parts


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def motion_compare(spark: SparkSession, args) -> DataFrame:
    """Per contiguous window: events, foreground and focus without and with compensation."""
    parts = [(*_compared(args, *part), part[1]) for part in motion_inputs(spark, args)]
    if args.output:
        frames = [panels.comparison_panels(m, motion.KEYS, c.width, c.height) for _, m, c in parts]
        together(frames).write.mode("errorifexists").parquet(args.output)
    return together([counts for counts, _, _ in parts])


def _compared(args, events: DataFrame, camera, intervals: DataFrame, cfg: MotionConfig) -> tuple[DataFrame, DataFrame]:
    keys = motion.KEYS
    windows = materialise(
        motion.window_grid(rolling.stream_bounds(events), intervals, cfg, args.start_s, args.end_s)
    )
    rotations = materialise(motion.window_rotations(windows, intervals, cfg))
    rows = materialise(
        motion.compensate(motion.window_events(events, windows, cfg), rotations, camera, with_original=True)
    )
    marked = foreground.segment(rows, keys, camera, cfg, "ox", "oy", "foreground_off")
    marked = foreground.segment(marked, keys, camera, cfg, "px", "py", "foreground_on")
    marked = materialise(marked.withColumn("foreground_on", F.col("foreground_on") & F.col("covered")))
    counts = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("foreground_off").alias("foreground_off"),
        F.count_if("foreground_on").alias("foreground_on"),
    )
    for name, x, y in (("focus_off", "ox", "oy"), ("focus_on", "px", "py")):
        energy = foreground.focus(rows, keys, camera.width, camera.height, x, y)
        counts = counts.join(energy.withColumnRenamed("focus", name), keys, "left")
    return counts, marked


def ball_3d(spark: SparkSession, args) -> DataFrame:
    setup = TrackerConfig(args.ball_diameter_m)
    return together([_tracked(args, setup, *part) for part in motion_inputs(spark, args)])


def _tracked(args, setup: TrackerConfig, events: DataFrame, camera, intervals: DataFrame, cfg: MotionConfig) -> DataFrame:
    span = (args.start_s, args.end_s) if args.seek_s is None else tracker.seek_span(args.seek_s, cfg.step_us)
    windows = materialise(motion.window_grid(rolling.stream_bounds(events), intervals, cfg, *span))
    candidates = tracker.window_candidates(events, windows, intervals, camera, cfg)
    poses = tracker.window_poses(windows, intervals, cfg)
    return materialise(tracker.track(windows, poses, candidates, camera, cfg, setup))


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    # The recording may come before the command.
    if len(argv) > 1 and argv[0] not in COMMANDS and argv[1] in COMMANDS:
        argv[0], argv[1] = argv[1], argv[0]
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lumenflow").getOrCreate()
    ship(spark)
    try:
        if args.command == "track-ball":
            lines = track_ball(spark, args)
            many = len(recordings(args)) > 1
            if args.output:
                writer = lines.select(*(["stream_id"] if many else []), "line").write.mode("errorifexists")
                (writer.partitionBy("stream_id") if many else writer).text(args.output)
            else:
                for row in lines.orderBy("stream_id", "timestamp_us").toLocalIterator():
                    print(f"{row.stream_id} {row.line}" if many else row.line)
        elif args.command == "motion-compare":
            found = materialise(motion_compare(spark, args))
            summary = found.groupBy("stream_id").agg(
                F.count(F.lit(1)).alias("windows"),
                F.sum("events").alias("events"),
                F.sum("foreground_off").alias("foreground_off"),
                F.sum("foreground_on").alias("foreground_on"),
                F.median(F.col("focus_on") / F.nullif("focus_off", F.lit(0))).alias("median_focus_gain"),
            )
            window_us = round(args.motion_window_ms * 1000)
            rates = found.select(
                "stream_id",
                "events",
                F.col("foreground_on").alias("foreground"),
                (F.col("events") * F.lit(1e6 / window_us)).alias("events_per_s"),
            )
            extra = metrics.rate_summary(rates).drop("windows", "events", "foreground")
            summary = summary.join(extra, "stream_id")
            for row in summary.orderBy("stream_id").toLocalIterator():
                print(row.asDict())
        else:
            tracks = ball_3d(spark, args)
            if args.tracks_csv:
                text.write_tracks(tracks, args.tracks_csv)
            if args.segments_json:
                lines = tables.segments_json(metrics.measured_segments(tracks))
                lines.write.mode("errorifexists").text(args.segments_json)
            if args.output:
                tracks.write.mode("errorifexists").parquet(args.output)
            for row in metrics.state_counts(tracks, ["stream_id"]).orderBy("stream_id").toLocalIterator():
                print(row.asDict())
            for row in metrics.track_summary(tracks).orderBy("stream_id", "track_id").toLocalIterator():
                print(
                    f"{row.stream_id} track {row.track_id}: {row.start_s:.2f}s to {row.end_s:.2f}s, {row.measured} measured "
                    f"({row.outlines} with outline), depth {row.min_depth_m:.2f} to {row.max_depth_m:.2f} m"
                )
    except (InvalidConfig, FileExistsError, FileNotFoundError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
