import numpy as np
import math

import pytest
from pyspark.sql import functions as F

from lumenflow.config import InvalidConfig
from lumenflow.functions.geometry import clock
from lumenflow.operators import metrics, panels
from lumenflow.operators.alignment import Alignment, proper_mounts
from lumenflow.operators.tracker import TRACK_NUMBERS
from lumenflow.sinks import text
from lumenflow.sources.calibration import parse_calibration, parse_pixel_mask


def test_calibration_text():
    nested = '{"image_width": 1280, "image_height": 720, "camera_matrix": [[863.9, 0.0, 587.0], [0.0, 864.1, 349.7], [0, 0, 1]], "distortion_coefficients": [-0.07, 0.1, -3e-4, 0.0, 0.5]}'
    camera = parse_calibration(nested)
    assert (camera.fx, camera.fy, camera.cx, camera.cy) == (863.9, 864.1, 587.0, 349.7)
    assert camera.distortion == (-0.07, 0.1, -3e-4, 0.0, 0.5) and (camera.width, camera.height) == (1280, 720)
    flat = parse_calibration('{"camera_matrix": {"data": [1, 0, 2, 0, 3, 4, 0, 0, 1]}, "distortion_coefficients": [1, 2]}')
    assert (flat.fx, flat.cx, flat.fy, flat.cy, flat.width) == (1, 2, 3, 4, None) and not any(flat.distortion)
    with pytest.raises(InvalidConfig):
        parse_calibration('{"camera_matrix": [1, 2]}')


def test_pixel_mask_text():
    assert parse_pixel_mask("87:24,121:306") == [(87, 24), (121, 306)]
    for bad in ("1280:0", "1", "a:b", ",".join("1:1" for _ in range(65))):
        with pytest.raises(InvalidConfig):
            parse_pixel_mask(bad)


def test_alignment_file(tmp_path):
    path = str(tmp_path / "a.alignment")
    mount = proper_mounts()[5]
    text.write_alignment(Alignment(1.25, mount, 1.5, 10), path)
    assert text.read_alignment(path) == (1.25, mount)
    with pytest.raises(FileExistsError):
        text.write_alignment(Alignment(1.25, mount, 1.5, 10), path)
    assert len(set(proper_mounts())) == 24
    for bad in ([1, 0, 0, 0, 1, 0, 0, 0, -1], [2, 0, 0, 0, 1, 0, 0, 0, 1], [1] * 8):
        with pytest.raises(InvalidConfig):
            text.check_mount([float(v) for v in bad])


def test_density_curve(spark):
    rows = spark.range(0, 400).select("id", panels.density_level(F.col("id")).alias("level")).collect()
    assert all(r.level == int(255 * (1 - math.exp(-min(r.id, 255) / 2))) for r in rows)


def test_clock(spark):
    row = spark.range(1).select(clock(F.lit(61_234_567)).alias("c")).first()
    assert row.c == "01:01.234"


def track_row(spark, state="measured", **numbers):
    values = {n: float(numbers[n]) if n in numbers else None for n in TRACK_NUMBERS}
    schema = "stream_id string, window_id long, time_s double, state string, track_id long, outline_supported boolean, " + ", ".join(f"{n} double" for n in TRACK_NUMBERS)
    return spark.createDataFrame([("s", 7, 0.07, state, 1, True, *values.values())], schema)


def test_track_file(spark, tmp_path):
    path = str(tmp_path / "tracks")
    text.write_tracks(track_row(spark, x_px=1.234, y_px=2, z_m=3.00006), path)
    written = spark.read.csv(path, header=True)
    row = written.first()
    assert len(written.columns) == 26  # 25 columns and the partition
    assert (row.time_s, row.state, row.track_id, row.outline_supported) == ("0.07", "measured", "1", "true")
    assert (row.x_px, row.y_px, row.z_m, row.x_m) == ("1.23", "2.00", "3.0001", None)
    with pytest.raises(Exception, match="already exists"):
        text.write_tracks(track_row(spark), path)


def test_detection_line(spark):
    schema = "stream_id string, timestamp_us long, window_start_us long, window_end_us long, centroid_x double, centroid_y double, min_x int, min_y int, max_x int, max_y int, event_count long, confidence double, circle struct<center_x:double,center_y:double,radius_px:double,inlier_count:int,inlier_ratio:double,mean_error_px:double>"
    rows = spark.createDataFrame(
        [("s", 5, 0, 5, 1.5, 2.25, 1, 2, 3, 4, 9, 0.5, None), ("s", 6, 1, 6, 1.5, 2.25, 1, 2, 3, 4, 9, 0.5, (1.0, 2.0, 3.0, 8, 0.9, 0.25))],
        schema,
    )
    lines = [r.line for r in text.detection_lines(rows).orderBy("timestamp_us").collect()]
    assert lines[0] == "t=5us window=0..5us centroid=(1.50,2.25) bbox=(1,2)->(3,4) events=9 confidence=0.500 circle=none parabola=none"
    assert "circle=(1.00,2.00) r=3.00px inliers=8 ratio=0.900 err=0.25px parabola=none" in lines[1]


def test_percentile_by_index(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in [5, 1, 4, 4, 2]] + [("b", 9.0)], "k string, v double")
    found = {r.k: (r.p50, r.p95, r.n) for r in metrics.index_percentiles(rows, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert found == {"a": (4.0, 5.0, 5), "b": (9.0, 9.0, 1)}


@pytest.mark.parametrize("accuracy", [10_000, 1])
def test_percentiles_with_outliers_ties_and_missed_brackets(spark, monkeypatch, accuracy):
    """A sketch that is far off opens its brackets; results are those of sorting either way."""
    monkeypatch.setattr(metrics, "SKETCH_MARGIN", 0 if accuracy == 1 else 3)
    monkeypatch.setattr(metrics, "SKETCH_ACCURACY", accuracy)
    rng = np.random.default_rng(21)
    values = {
        "outlier": [*rng.normal(0, 1, 3000), 1e300, -1e300],
        "ties": [*rng.integers(0, 4, 2000).astype(float)],
        "infinite": [*rng.normal(5, 1, 500), float("inf"), float("inf"), float("-inf")],
        "equal": [7.0] * 300,
        "one": [3.0],
    }
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("ties", None), ("empty", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(7)
    shares = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p999": 0.999, "p100": 1.0}
    found = {r.k: r for r in metrics.index_percentiles(frame, ["k"], "v", shares).collect()}
    assert set(found) == set(values)
    for k, vs in values.items():
        ordered, n = sorted(map(float, vs)), len(vs)
        assert (found[k].n, found[k].max) == (n, ordered[-1])
        assert {s: found[k][s] for s in shares} == {s: ordered[min(int(n * p), n - 1)] for s, p in shares.items()}
