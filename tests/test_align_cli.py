import json
import math

import numpy as np
import pytest

from fixtures import event_table, imu_table, crossing_ball, simple_camera
from lumenflow import cli
from lumenflow.config import InvalidConfig, MotionConfig
from lumenflow.operators import alignment, imu
from lumenflow.sinks.text import read_alignment

TRUE_OFFSET = 0.1
#: IMU x axis is camera z, y is x, z is y.
TRUE_MOUNT = np.array([[0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 0.0, 0.0]])


def camera_rate(t):
    return np.array([0.8 * math.sin(2.1 * t), 0.9 * math.cos(1.3 * t), 0.7 * math.sin(3.3 * t + 1)])


def turning_background(slots=10):
    """Short bursts of a static dot pattern seen by a camera that turns in all axes (320 x 240)."""
    rng = np.random.default_rng(11)
    dots = np.column_stack([rng.uniform(-0.3, 0.3, 60), rng.uniform(-0.2, 0.2, 60), np.ones(60)])
    rows = []
    for slot in range(slots):
        start = slot * 350_000
        middle = (start + 15_000) * 1e-6
        for us in range(0, 30_000, 1000):
            dt = (start + us) * 1e-6 - middle
            # Apparent motion is opposite to the camera's turn.
            seen = dots - np.cross(camera_rate(middle), dots) * dt
            px = 300 * seen[:, 0] / seen[:, 2] + 160
            py = 300 * seen[:, 1] / seen[:, 2] + 120
            rows += [(start + us, round(a), round(b)) for a, b in zip(px, py) if 0 <= a < 319.5 and 0 <= b < 239.5]
    return rows


def test_alignment_finds_offset_and_mount(spark):
    times = np.arange(0, 5, 0.01)
    rates = np.array([TRUE_MOUNT.T @ camera_rate(t - TRUE_OFFSET) for t in times])
    samples = imu_table(spark, times.tolist(), gyro=rates.T.tolist())
    intervals = imu.prepared_imu(samples)
    events = event_table(spark, turning_background())
    camera = simple_camera(300, 320, 240)
    found = alignment.auto_align(events, intervals, camera, 0.0, 0.2, min_events=500)
    assert found.focus_gain > 1.3 and found.windows >= 6
    assert abs(found.offset_s - TRUE_OFFSET) < 0.03
    assert np.abs(np.array(found.mount) - TRUE_MOUNT).max() < 0.1
    still = imu.prepared_imu(imu_table(spark, times.tolist()))
    with pytest.raises(InvalidConfig):
        alignment.auto_align(events, still, camera, 0.0, 0.05, min_events=500)


def pack_evt2(rows):
    words, high = [], None
    for t, x, y, *_ in rows:
        if t >> 6 != high:
            high = t >> 6
            words.append((8 << 28) | high)
        words.append((1 << 28) | ((t & 63) << 22) | (x << 11) | y)
    return np.array(words, "<u4").tobytes()


@pytest.fixture(scope="module")
def ring_files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("ring")
    (folder / "ring.raw").write_bytes(b"% evt 2.0\n% geometry 720x540\n" + pack_evt2(crossing_ball(200)))
    (folder / "imu.csv").write_text("timestamp,gx,gy,gz\n" + "".join(f"{i * 0.01},0,0,0\n" for i in range(60)))
    (folder / "calibration.json").write_text(
        json.dumps({"image_width": 720, "image_height": 540, "camera_matrix": [[620, 0, 360], [0, 620, 270], [0, 0, 1]]})
    )
    (folder / "a.alignment").write_text("0.0\n1,0,0,0,1,0,0,0,1\n")
    return folder


def test_track_ball_command(spark, ring_files, capsys):
    recording = str(ring_files / "ring.raw")
    assert cli.main([recording, "track-ball", "--max-detections", "3", "--no-circle-fit", "--min-events", "50"]) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert len(lines) == 3 and all(line.startswith("t=") and "circle=none" in line for line in lines)


def test_filter_options_take_effect(ring_files, capsys):
    command = [str(ring_files / "ring.raw"), "track-ball", "--no-circle-fit", "--min-events", "50", "--max-detections", "2"]
    assert cli.main([*command, "--filter-background-activity", "--background-radius-px", "0"]) == 0
    assert capsys.readouterr().out == ""  # nothing supports an event within no distance
    static = ["--filter-static", "--static-min-events", "1", "--static-stable-after-us", "0", "--static-cell-size", "720"]
    assert cli.main([*command, *static]) == 0
    assert capsys.readouterr().out == ""  # one cell holds all events
    assert cli.main([*command, "--filter-static", "--static-cell-size", "0"]) == 1
    assert "static_cell_size" in capsys.readouterr().err


def test_ball_3d_command(spark, ring_files, capsys):
    files = {n: str(ring_files / n) for n in ("ring.raw", "imu.csv", "calibration.json", "a.alignment")}
    out = str(ring_files / "tracks")
    command = [
        "ball-3d", files["ring.raw"], "--imu", files["imu.csv"], "--calibration", files["calibration.json"],
        "--alignment", files["a.alignment"], "--ball-diameter-m", "0.09", "--tracks-csv", out,
        "--segments-json", out + "-segments",
    ]
    assert cli.main(command) == 0
    assert "track 1:" in capsys.readouterr().out
    lines = [json.loads(r.value) for r in spark.read.text(out + "-segments").collect()]
    assert [d["track_id"] for d in lines] == [1] and sum(s["updates"] for s in lines[0]["segments"]) > 5
    rows = spark.read.csv(out, header=True)
    assert rows.where("state = 'measured'").count() > 5
    assert read_alignment(files["a.alignment"])[0] == 0.0


def test_motion_compare_command(spark, ring_files, capsys):
    files = {n: str(ring_files / n) for n in ("ring.raw", "imu.csv", "calibration.json", "a.alignment")}
    frames = str(ring_files / "frames")
    command = [
        "motion-compare", files["ring.raw"], "--imu", files["imu.csv"], "--calibration", files["calibration.json"],
        "--alignment", files["a.alignment"], "--output", frames,
    ]
    assert cli.main(command) == 0
    shown = capsys.readouterr().out
    assert "median_focus_gain" in shown and "events_per_s_p95" in shown
    assert spark.read.parquet(frames).select("panel").distinct().count() == 4


@pytest.fixture(scope="module")
def two_recordings(tmp_path_factory, ring_files):
    """The same ball in two recordings, the second one shorter; a camera at rest."""
    folder = tmp_path_factory.mktemp("several")
    (folder / "raw").mkdir()
    (folder / "imu").mkdir()
    for name, updates in (("one", 200), ("two", 160)):
        body = b"% evt 2.0\n% geometry 720x540\n" + pack_evt2(crossing_ball(updates))
        (folder / "raw" / f"{name}.raw").write_bytes(body)
        (folder / "imu" / f"{name}.csv").write_text((ring_files / "imu.csv").read_text())
    return folder


def several(command, folder, ring_files, *more):
    calibration, aligned = str(ring_files / "calibration.json"), str(ring_files / "a.alignment")
    return [command, str(folder / "raw"), "--calibration", calibration, "--alignment", aligned, *more]


@pytest.mark.parametrize("imu_folder", ["imu", None])
def test_ball_3d_of_several_recordings(spark, ring_files, two_recordings, capsys, imu_folder):
    out = str(two_recordings / f"tracks-{imu_folder}")
    more = ["--imu", str(two_recordings / imu_folder)] if imu_folder else []
    command = several("ball-3d", two_recordings, ring_files, "--ball-diameter-m", "0.09", "--output", out, *more)
    assert cli.main(command) == 0
    shown = capsys.readouterr().out
    assert "one.raw track 1:" in shown and "two.raw track 1:" in shown
    measured = spark.read.parquet(out).where("state = 'measured'").groupBy("stream_id").count().collect()
    assert {r.stream_id for r in measured} == {"one.raw", "two.raw"} and all(r["count"] > 5 for r in measured)


def test_several_recordings_need_samples_each(ring_files, two_recordings, tmp_path, capsys):
    (tmp_path / "one.csv").write_text((ring_files / "imu.csv").read_text())
    more = ["--ball-diameter-m", "0.09", "--imu", str(tmp_path)]
    assert cli.main(several("ball-3d", two_recordings, ring_files, *more)) == 1
    assert "two.raw" in capsys.readouterr().err
    search = [*several("ball-3d", two_recordings, ring_files, *more[:2], "--imu", str(two_recordings / "imu")), "--auto-align"]
    assert cli.main(search) == 1
    assert "of one.raw" in capsys.readouterr().err  # its camera is at rest


def test_each_recording_of_a_run_is_aligned(spark, ring_files, two_recordings, tmp_path, monkeypatch):
    offsets = {"one.raw": 0.0, "two.raw": 5.0}  # the samples of the second end before its events begin

    def search(events, intervals, *_):
        (name,) = {r.stream_id for t in (events, intervals) for r in t.select("stream_id").distinct().collect()}
        return alignment.Alignment(offsets[name], MotionConfig().mount, 2.0, 6)

    monkeypatch.setattr(alignment, "auto_align", search)
    out, saved = str(tmp_path / "tracks"), str(tmp_path / "found")
    command = several("ball-3d", two_recordings, ring_files, "--ball-diameter-m", "0.09", "--output", out)
    assert cli.main([*command, "--imu", str(two_recordings / "imu"), "--auto-align", "--save-alignment", saved]) == 0
    assert {n: read_alignment(f"{saved}.{n}")[0] for n in offsets} == offsets
    measured = spark.read.parquet(out).where("state = 'measured'").groupBy("stream_id").count().collect()
    assert {r.stream_id for r in measured} == {"one.raw"}


def test_track_ball_of_several_recordings(spark, two_recordings, tmp_path):
    out = str(tmp_path / "lines")
    command = [str(two_recordings / "raw"), "track-ball", "--max-detections", "3", "--no-circle-fit", "--min-events", "50"]
    assert cli.main([*command, "--output", out]) == 0
    rows = spark.read.text(out).groupBy("stream_id").count().collect()
    assert {r.stream_id: r["count"] for r in rows} == {"one.raw": 3, "two.raw": 3}


def test_recordings_of_one_size_only(spark, two_recordings, tmp_path, capsys):
    for name, size in (("a", b"720x540"), ("b", b"640x480")):
        (tmp_path / f"{name}.raw").write_bytes(b"% evt 2.0\n% geometry " + size + b"\n" + pack_evt2(crossing_ball(2)))
    assert cli.main([str(tmp_path), "track-ball"]) == 1
    assert "one sensor size" in capsys.readouterr().err
