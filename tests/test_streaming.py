import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import event_table
from test_evt import random_evt3
from test_filters import brute_background, brute_static, random_rows
from lumenflow.config import BackgroundConfig, ClusterConfig, InvalidConfig, MotionConfig, StaticConfig, TrackerConfig
from lumenflow.operators import imu, tracker
from lumenflow.schema import EVENT
from lumenflow.sources import evt as source
from lumenflow.streaming import filters, imu as live_imu, tracks, windows


def feed(spark, tmp_path, frame, schema, parts=4, name="in"):
    """A file stream that delivers ``frame`` in pieces, shuffled inside each piece."""
    folder = str(tmp_path / name)
    total = frame.count()
    for i in range(parts):
        low, high = total * i // parts, total * (i + 1) // parts
        frame.where(F.col("seq").between(low, high - 1)).orderBy(F.rand(i)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, name, tmp_path):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


@pytest.fixture()
def scene(spark, tmp_path):
    # A far-away closing event moves the watermark past everything before it.
    rows = [(t + 1000, x, y) for t, x, y in random_rows(6, count=400)]
    rows.append((rows[-1][0] + 60_000_000, 0, 0))
    return rows, feed(spark, tmp_path, event_table(spark, rows), EVENT)


def test_background_stream_equals_batch(spark, tmp_path, scene):
    rows, stream = scene
    cfg = BackgroundConfig(2, 300, tile_px=8)
    got = run(filters.background_stream(stream, cfg, 50_000), "bg", tmp_path).orderBy("seq").collect()
    assert [r.supported for r in got] == brute_background(rows, 2, 300)[: len(got)]
    assert len(got) == len(rows) - 1


def test_static_stream_equals_batch(spark, tmp_path, scene):
    rows, stream = scene
    cfg = StaticConfig(4, 2000, 12, 5000)
    got = run(filters.static_stream(stream, cfg, 50_000), "st", tmp_path).orderBy("seq").collect()
    assert [r.is_static for r in got] == brute_static(rows, cfg)[: len(got)]
    assert len(got) == len(rows) - 1


def test_window_stream_equals_batch(spark, tmp_path, scene):
    rows, stream = scene
    cfg = ClusterConfig(4000, 2000, 2, min_events=3, min_cells=1)
    got = run(windows.cell_stream(stream, cfg, 50_000), "cells", tmp_path)
    last = rows[-2][0]
    want = {}
    for t, x, y in rows[:-1]:
        for k in range(-(-t // 2000), (t + 4000) // 2000 + 1):
            key = (k * 2000, x // 2, y // 2)
            want[key] = want.get(key, 0) + 1
    found = {(r.tick_us, r.cx, r.cy): r.n for r in got.collect()}
    assert {k: v for k, v in found.items() if k[0] <= last} == {k: v for k, v in want.items() if k[0] <= last}
    assert windows.detect(got, cfg, (40, 30)).count() > 0


def test_track_stream_equals_batch(spark, tmp_path):
    from lumenflow.catalog import TRACK_CAMERA

    n = 60
    rows = []
    for i in range(n):
        there = i < 25 and i % 7 != 3
        rows.append(
            (
                "s", i, i, (i + 1) * 10_000, (i + 1) * 0.01, True, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0,
                *((1, 100.0 + 6 * i, 200.0, 20.0, 20.0, 100, True) if there else (None,) * 7),
            )
        )
    schema = (
        "stream_id string, seq long, window_id long, end_us long, time_s double, covered boolean, "
        "qw double, qx double, qy double, qz double, s_qw double, s_qx double, s_qy double, s_qz double, "
        "gravity_x double, gravity_y double, gravity_z double, "
        "rank int, x double, y double, width double, height double, events long, has_outline boolean"
    )
    rows.append((*rows[-1][:1], n, n, 60_000_000, 60.0, *rows[-1][5:]))
    frame = spark.createDataFrame(rows, schema)
    stream = feed(spark, tmp_path, frame, schema)
    live = tracks.track_stream(stream, TRACK_CAMERA, MotionConfig(), TrackerConfig(0.07), 100_000)
    got = run(live, "live_tracks", tmp_path).orderBy("window_id").toPandas()
    machine = tracker.TrackMachine(TRACK_CAMERA, MotionConfig(), 0.07)
    want = machine(frame.toPandas().assign(episode=0).sort_values("window_id"))
    assert len(got) == n
    for name in ("state", "local_track", "has_flight"):
        assert got[name].tolist() == want[name].tolist()[:n]
    assert "measured" in set(got.state) and "predicted" in set(got.state)
    assert np.allclose(got.z_m, want.z_m[:n], equal_nan=True)


def test_unwrap_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    path = folder / "a.raw"
    words = random_evt3(3000, seed=8).copy()
    high = np.flatnonzero((words >> 12) == 0x8)
    words[high] = 0x8000 | (np.arange(len(high)) * 700 % 4096)
    data = b"% evt 3.0\n" + words.tobytes()
    path.write_bytes(data[:2000])
    spark.dataSource.register(source.EvtDataSource)
    reader = spark.readStream.format("evt").option("path", str(folder)).option("timeRows", "true").option("live", "true")
    query = (
        tracks.unwrap_stream(reader.load()).writeStream.format("memory").queryName("unwrapped").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "check")).start()
    )
    try:
        query.processAllAvailable()
        path.write_bytes(data)
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.table("unwrapped").orderBy("seq").collect()
    want = source.read_events(spark, str(path), unwrap=True).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert got[-1].timestamp_us > 1 << 24


SAMPLE = "stream_id string, seq long, time_s double, gx double, gy double, gz double, gravity_x double, gravity_y double, gravity_z double"


def random_samples(seed, streams=("a", "b")):
    """Samples with two gaps and repeated times, and two far ones that let the stream pass the others."""
    rng = np.random.default_rng(seed)
    rows = []
    for name in streams:
        times = np.cumsum(rng.uniform(0.004, 0.02, 200))
        times[60:] += 0.4
        times[130:] += 0.0501
        for t in [*times.tolist(), 100.0, 200.0]:
            rows.append((name, t, *rng.normal(0, 2, 3).tolist(), *(rng.normal(0, 0.1, 3) + [0, 1, 0]).tolist()))
    rows.sort(key=lambda r: r[1])
    rows = [(r[0], i, *r[1:]) for i, r in enumerate(rows)]
    again = [(*r[:3], *(v + 1 for v in r[3:])) for r in rows[5:40:7]]
    return rows, again


@pytest.fixture()
def live_samples(spark, tmp_path):
    rows, _ = random_samples(3)
    rng = np.random.default_rng(4)
    known = {n: [r[2] for r in rows if r[0] == n and r[2] < 50] for n in "ab"}
    points = [(n, float(t)) for n in "ab" for t in [*rng.uniform(-0.1, 1.6, 150), *known[n][20:90:9]]]
    points = sorted([*points, ("a", 100.0), ("b", 100.0)], key=lambda p: p[1])
    points = [(n, i, (1 << 60) + i, t) for i, (n, t) in enumerate(points)]
    schema = "stream_id string, seq long, mark long, time_s double"
    samples, asked = spark.createDataFrame(rows, SAMPLE), spark.createDataFrame(points, schema)
    return samples, asked, feed(spark, tmp_path, samples, SAMPLE, 5, "samples"), feed(spark, tmp_path, asked, schema, 4, "points")


def same_rows(got, want, exact):
    got, want = (d.sort_values("seq").reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want) > 100
    for name in want.columns:
        if name in exact:
            assert got[name].tolist() == want[name].tolist()
        elif name == "down":
            assert np.allclose([list(v) for v in got[name]], [list(v) for v in want[name]])
        else:
            assert np.allclose(got[name], want[name])


def test_gyro_of_two_streams_equals_batch(spark, tmp_path, live_samples):
    samples, asked, sample_stream, point_stream = live_samples
    got = run(live_imu.gyro_stream(point_stream, sample_stream, 100_000), "gyros", tmp_path).toPandas()
    want = imu.gyro_at(asked.where("time_s < 50"), imu.prepared_imu(samples.drop("seq"))).toPandas()
    same_rows(got, want, {"stream_id", "seq", "mark"})


def test_orientation_of_two_streams_equals_batch(spark, tmp_path, live_samples):
    samples, asked, sample_stream, point_stream = live_samples
    table = str(tmp_path / "oriented")
    writer = (
        live_imu.orient_stream(sample_stream, 100_000).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "first")).trigger(availableNow=True).start(table)
    )
    writer.awaitTermination(120)
    assert spark.read.parquet(table).count() == samples.count() - 2
    oriented = spark.readStream.schema(live_imu.ORIENTED_TYPE).parquet(table)
    got = run(live_imu.orientation_stream(point_stream, oriented, 100_000), "turns", tmp_path).toPandas()
    want = imu.orientation_at(asked.where("time_s < 50"), imu.prepared_imu(samples.drop("seq"))).toPandas()
    same_rows(got, want, {"stream_id", "seq", "mark", "gap_count", "gap_floor"})


def test_repeated_samples_are_ignored():
    import pandas as pd

    rows, again = random_samples(9, ("a",))
    columns = [c.split()[0] for c in SAMPLE.split(", ")]
    plain = pd.DataFrame(rows, columns=columns)
    repeated = pd.concat([plain, pd.DataFrame(again, columns=columns)]).sort_values("time_s", kind="stable")
    one, whole = live_imu.Integrator(), live_imu.Integrator()
    parts = pd.concat([one(repeated.iloc[a : a + 17]) for a in range(0, len(repeated), 17)], ignore_index=True)
    assert parts.equals(whole(plain).reset_index(drop=True))


def piled_up(count, step_us=10_000):
    """Updates of one sensor without candidates."""
    import pandas as pd

    ids = np.arange(1, count + 1)
    frame = pd.DataFrame({"stream_id": "s", "window_id": ids, "end_us": ids * step_us, "time_s": ids * step_us * 1e-6, "covered": True})
    for name, value in {"qw": 1.0, "s_qw": 1.0, "gravity_y": 1.0}.items():
        frame[name] = value
    for name in ("qx", "qy", "qz", "s_qx", "s_qy", "s_qz", "gravity_x", "gravity_z"):
        frame[name] = 0.0
    for name in ("rank", "x", "y", "width", "height", "events", "has_outline"):
        frame[name] = None
    return frame


def test_lag_is_measured_against_the_newest_input():
    from lumenflow.catalog import TRACK_CAMERA

    frame = piled_up(100)
    live = tracks.LiveTracker(TRACK_CAMERA, MotionConfig(), 0.07, 150_000)
    live.newest(100_000)
    assert live(frame.iloc[:5]).skipped.tolist() == [0] * 5
    # The newest input is at 40 steps, of which only 30 are due: steps 6 to 39 are left out.
    live.newest(400_000)
    assert live(frame.iloc[5:30]).empty
    live.newest(450_000)
    out = live(frame.iloc[30:42])
    assert out.window_id.tolist() == [40, 41, 42] and out.skipped.tolist() == [34] * 3
    # 15 steps behind is still in time, 16 is not.
    live.newest(580_000)
    assert live(frame.iloc[42:44]).window_id.tolist() == [43, 44]
    live.newest(610_000)
    out = live(frame.iloc[44:61])
    assert out.window_id.tolist() == [61] and out.skipped.tolist() == [34 + 16]


def test_lagging_stream_skips_ahead(spark, tmp_path):
    from lumenflow.catalog import TRACK_CAMERA

    schema = (
        "stream_id string, seq long, window_id long, end_us long, time_s double, covered boolean, "
        "qw double, qx double, qy double, qz double, s_qw double, s_qx double, s_qy double, s_qz double, "
        "gravity_x double, gravity_y double, gravity_z double, "
        "rank int, x double, y double, width double, height double, events long, has_outline boolean"
    )
    rows = piled_up(130).assign(seq=np.arange(130))
    columns = [c.split()[0] for c in schema.split(", ")]
    frame = spark.createDataFrame([tuple(r) for r in rows[columns].astype(object).itertuples(index=False)], schema)
    folder = str(tmp_path / "in")
    for low, high in ((0, 60), (60, 121), (121, 130)):
        frame.where(F.col("seq").between(low, high - 1)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with pytest.raises(InvalidConfig):
        tracks.track_stream(stream, TRACK_CAMERA, MotionConfig(), TrackerConfig(0.07), 150_000, 150_000)
    live = tracks.track_stream(stream, TRACK_CAMERA, MotionConfig(), TrackerConfig(0.07), 50_000, 150_000)
    got = run(live, "lagging", tmp_path).orderBy("window_id").toPandas()
    # The second delivery shows that the first is late: all before its newest update is left out.
    assert got.window_id.tolist() == [121, 122, 123, 124] and set(got.skipped) == {120}
