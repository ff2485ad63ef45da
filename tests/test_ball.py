import numpy as np
import pytest

from lumenflow.config import BallConfig, CameraModel, InvalidConfig, ParabolaConfig, default_camera, rescale_default_camera
from lumenflow.operators import ball

DETECTION = (
    "stream_id string, timestamp_us long, centroid_x double, centroid_y double, min_x int, min_y int, "
    "max_x int, max_y int, confidence double"
)
CAMERA = CameraModel(1000.0, 1000.0, 320.0, 240.0)
PARABOLA = ParabolaConfig(CAMERA, ball_diameter_m=0.1, inlier_threshold_m=0.08)


def test_depth_from_the_bounding_box(spark):
    rows = spark.createDataFrame([("s", 0, 320.0, 240.0, 0, 0, 19, 19, 1.0)], DETECTION)
    assert ball.ball_measurements(rows, BallConfig(0.1, CAMERA, "bbox_average")).first().z_m == 5.0
    assert ball.parabola_points(rows, PARABOLA).first().z_m == pytest.approx(5.0)


def test_smoothing_starts_at_the_first_measurement_and_follows(spark):
    rows = spark.createDataFrame(
        [("s", i * 10_000, 320.0 + 10 * i, 240.0, 0, 0, 19, 19, 1.0) for i in range(60)], DETECTION
    )
    measured = ball.ball_measurements(rows, BallConfig(0.1, CAMERA, "bbox_max"))
    path = ball.smooth_path(measured).orderBy("timestamp_us").collect()
    assert path[0].smooth_x_m == 0.0 and path[0].speed_mps == 0.0
    # 10 px per 10 ms at 5 m and a focal length of 1000 px is 5 m/s.
    assert path[-1].vx_mps == pytest.approx(5.0, rel=0.1)
    assert path[-1].smooth_z_m == pytest.approx(5.0)


def sequential_path(rows):
    """The filter of one stream, one measurement after the other, with an explicit three-axis state."""
    state, out = None, []
    for t, *z in sorted(rows):
        if state is None:
            state = np.array([*z, 0.0, 0.0, 0.0]), np.eye(6)
        else:
            dt = max((t - last) * 1e-6, 1e-6)
            move = np.eye(6) + dt * np.eye(6, k=3)
            noise = 0.05 * np.diag([dt * dt] * 3 + [1.0] * 3)
            mean, cov = move @ state[0], move @ state[1] @ move.T + noise
            seen = np.eye(3, 6)
            gain = cov @ seen.T @ np.linalg.inv(seen @ cov @ seen.T + 0.02 * np.eye(3))
            state = mean + gain @ (np.array(z) - seen @ mean), (np.eye(6) - gain @ seen) @ cov
        last = t
        out.append((t, *state[0]))
    return out


@pytest.mark.parametrize("block_us", [1, 7_000, 90_000, 10**12])
def test_smoothing_in_blocks_equals_one_pass(spark, block_us):
    """Two streams with pauses, equal times and blocks of one row, in any number of blocks."""
    rng = np.random.default_rng(71)
    rows = []
    for stream in "ab":
        t = np.cumsum(rng.choice([0, 900, 4_000, 60_000, 700_000], 120, p=[0.15, 0.3, 0.3, 0.2, 0.05])) + 5
        rows += [(stream, int(at), *(float(v) for v in rng.normal(0, 1, 3)), 9.0, 0.5) for at in t]
    table = spark.createDataFrame(rows, "stream_id string, timestamp_us long, x_m double, y_m double, z_m double, pixel_diameter double, confidence double")
    got = ball.smooth_path(table.repartition(3), block_us).orderBy("stream_id", "timestamp_us", "x_m").collect()
    want = [(s, *r) for s in "ab" for r in sequential_path([r[1:5] for r in rows if r[0] == s])]
    assert [r.stream_id for r in got] == [w[0] for w in want]
    found = np.array([(r.timestamp_us, *(r[n] for n in ball.SMOOTHED)) for r in got])
    assert np.allclose(found, np.array([w[1:] for w in want], float), rtol=1e-9, atol=1e-9)
    assert np.allclose([r.speed_mps for r in got], np.linalg.norm(found[:, 4:], axis=1))


def test_smoothing_of_nothing(spark):
    none = spark.createDataFrame([], "stream_id string, timestamp_us long, x_m double, y_m double, z_m double, pixel_diameter double, confidence double")
    assert ball.smooth_path(none).count() == 0


def points(spark, rows):
    return spark.createDataFrame(rows, "stream_id string, timestamp_us long, x_m double, y_m double, z_m double")


def flight(t):
    p, v, g = (0.2, 0.3, 4.0), (1.0, -2.0, -3.0), PARABOLA.gravity
    return [a + b * t + 0.5 * c * t * t for a, b, c in zip(p, v, g)]


def test_parabola_recovers_the_launch(spark):
    rows = [("s", round(i * 0.05 * 1e6), *flight(i * 0.05)) for i in range(8)]
    fits = ball.parabola_fits(points(spark, rows), PARABOLA).orderBy("timestamp_us").collect()
    assert [f.fit is not None for f in fits] == [False] * 3 + [True] * 5
    fit = fits[-1].fit
    assert fit.inlier_count == 8
    assert (fit.px, fit.py, fit.pz) == pytest.approx((0.2, 0.3, 4.0), abs=1e-3)
    assert (fit.vx, fit.vy, fit.vz) == pytest.approx((1.0, -2.0, -3.0), abs=1e-3)


def test_parabola_ignores_outliers_and_rejects_equal_times(spark):
    rows = [("s", round(i * 0.05 * 1e6), *flight(i * 0.05)) for i in range(10)]
    for i in (3, 7):
        rows[i] = (*rows[i][:2], rows[i][2] + 2.0, *rows[i][3:])
    fit = ball.parabola_fits(points(spark, rows), PARABOLA).orderBy("timestamp_us").collect()[-1].fit
    assert (fit.inlier_count, fit.total_count) == (8, 10)
    assert [i for i, ok in enumerate(fit.inliers) if not ok] == [3, 7]
    close = [("s", i, *flight(0.0)) for i in range(6)]
    assert all(r.fit is None for r in ball.parabola_fits(points(spark, close), PARABOLA).collect())


def test_default_intrinsics_follow_the_view():
    small = default_camera(640, 480)
    assert (small.fx, small.fy, small.cx, small.cy) == (410.0, 409.0, 320.0, 240.0)
    moved = rescale_default_camera(CameraModel(410.0, 999.0, 320.0, 240.0), (640, 480), (1280, 720))
    assert (moved.fx, moved.fy, moved.cx, moved.cy) == (820.0, 999.0, 640.0, 360.0)


def test_settings_are_validated():
    with pytest.raises(InvalidConfig):
        BallConfig(diameter_m=0)
    for change in ({"buffer_len": 1}, {"min_points": 60}, {"min_inlier_ratio": 1.5}, {"max_depth_m": 0.01}):
        with pytest.raises(InvalidConfig):
            ParabolaConfig(**change)
    with pytest.raises(InvalidConfig):
        CameraModel(1.0, 1.0, 0.0, 0.0, width=10, height=10).for_sensor(11, 10)


def test_a_disabled_ball_measures_nothing(spark):
    box = spark.createDataFrame([(1, 2, 5, 8, 3.0, 5.0)], "min_x int, min_y int, max_x int, max_y int, centroid_x double, centroid_y double")
    on, off = (ball.ball_measurements(box, BallConfig(0.07, diameter_source="bbox_max", enabled=e)) for e in (True, False))
    assert on.count() == 1 and off.count() == 0 and on.columns == off.columns
