from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtures import event_table, imu_table, projected, simple_camera, turn_matrix, turning_scene, window_rows
from lumenflow import catalog, catalog_sql
from lumenflow.config import InvalidConfig, MotionConfig
from lumenflow.functions import geometry as g
from lumenflow.operators import foreground, imu, motion
from lumenflow.operators.rolling import stream_bounds
from lumenflow.plans.lineage import materialise
from lumenflow.plans.ordered import joined_in_place
from lumenflow.sources.imu import read_imu_csv
from oracle import difference

KEYS = ["stream_id", "window_id"]


def plain_foreground(rows, camera, cfg):
    """Rows of (start, end, time, px, py) of one window: whether each lies in a kept region."""
    places = [None if px is None or not (0 <= px < camera.width and 0 <= py < camera.height)
              else (int(px) // cfg.cell_px, int(py) // cfg.cell_px) for *_, px, py in rows]
    ages = defaultdict(list)
    for (start, end, time, *_), place in zip(rows, places):
        if place is not None:
            ages[place].append((time - start) / max(end - start, 1))
    means = {c: sum(a) / len(a) for c, a in ages.items()}
    occupied = [c for c in ages if len(ages[c]) >= cfg.min_events]
    whole = sum(means[c] for c in occupied) / len(occupied) if occupied else 0.0
    late = {c for c in occupied if means[c] - whole > cfg.threshold}
    early = {c: sum(a < 0.25 for a in ages[c]) for c in ages}
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    kept, left = set(), set(late)
    while left:
        region, stack = set(), [left.pop()]
        while stack:
            x, y = stack.pop()
            region.add((x, y))
            near = {(x + i, y + j) for i, j in around} & left
            left -= near
            stack += near
        support = {c: sum(early.get((c[0] + i, c[1] + j), 0) for i, j in around) for c in region}
        new = sum(cfg.min_new_fraction == 0 or n < cfg.min_events for n in support.values())
        if len(region) >= cfg.min_component_cells and new >= len(region) * cfg.min_new_fraction:
            kept |= region
    return [c in kept for c in places]


@pytest.mark.parametrize("new_fraction", [0.0, 0.4, 1.0])
def test_kept_regions_match_a_plain_reading(spark, new_fraction):
    """Random patches that begin early, late or both, in several windows of two streams."""
    rng = np.random.default_rng(41)
    camera = simple_camera(50, 64, 48)
    cfg = MotionConfig(cell_px=2, threshold=0.1, min_events=2, min_component_cells=3, min_new_fraction=new_fraction)
    data, seq = [], 0
    for stream in "ab":
        for window in range(4):
            start, end = 20_000 * window, 20_000 * window + int(rng.integers(9_000, 15_000))
            for _ in range(14):
                corner, size = rng.uniform([-3, -3], [62, 46]), rng.uniform(1, 9, 2)
                first = rng.choice([0.0, 0.0, 0.6])
                for _ in range(int(rng.integers(5, 90))):
                    place = corner + rng.random(2) * size
                    time = start + int((first + (1 - first) * rng.random()) * (end - start))
                    data.append((stream, window, seq, start, end, time, *place.tolist()))
                    seq += 1
            data.append((stream, window, seq, start, end, start, None, None))
            seq += 1
    rows = spark.createDataFrame(data, "stream_id string, window_id long, seq long, start_us long, end_us long, timestamp_us long, px double, py double")
    got = {r.seq: r.foreground for r in foreground.segment(rows, KEYS, camera, cfg).collect()}
    for stream in "ab":
        for window in range(4):
            own = [r for r in data if r[:2] == (stream, window)]
            assert [got[r[2]] for r in own] == plain_foreground([r[3:] for r in own], camera, cfg)
    assert 0 < sum(got.values()) < len(got)


RATE = (0.7, -1.1, 0.9)


@pytest.fixture(scope="module")
def rotating(spark):
    camera = simple_camera(210, 260, 180)
    rows = turning_scene(camera, RATE, 36, seed=43)
    samples = imu_table(spark, [i * 0.01 for i in range(21)], gyro=RATE)
    return rows, camera, event_table(spark, rows), imu.prepared_imu(samples)


def compensated(spark, scene, cfg):
    _, camera, events, intervals = scene
    window = motion.window_times(
        spark.createDataFrame([("s", 0, 0, 35_000)], "stream_id string, window_id long, origin_us long, end_us long"),
        cfg,
    )
    rotations = motion.window_rotations(window, intervals, cfg)
    return motion.compensate(window_rows(events, 0, 35_000), rotations, camera, with_original=True)


def test_rotation_about_any_axis_is_removed(spark, rotating):
    """Every event goes where its direction is seen at the end of the window."""
    rows, camera, _, _ = rotating
    cfg = MotionConfig(window_us=35_000, cell_px=4, min_component_cells=4)
    placed = compensated(spark, rotating, cfg)
    got = placed.orderBy("seq").toPandas()
    assert got.covered.all()
    back = turn_matrix(np.multiply(RATE, 0.035)).T
    for time, own in got.groupby("timestamp_us"):
        turn = back @ turn_matrix(np.multiply(RATE, time * 1e-6))
        x, y = projected(camera, own[["x", "y"]].to_numpy(float).T, turn)
        inside = own.px.notna().to_numpy()
        assert inside.any()
        assert np.abs(own.px.to_numpy() - x)[inside].max() < 0.01 and np.abs(own.py.to_numpy() - y)[inside].max() < 0.01
    sharp, blurred = (foreground.focus(placed, KEYS, camera.width, camera.height, *c).first()["focus"] for c in (("px", "py"), ("ox", "oy")))
    assert sharp > blurred
    marked = foreground.segment(placed, KEYS, camera, cfg).orderBy("seq").toPandas()
    flat = [(r.start_us, r.end_us, r.timestamp_us, *((None, None) if r.px != r.px else (r.px, r.py))) for r in marked.itertuples()]
    assert marked.foreground.tolist() == plain_foreground(flat, camera, cfg)


def test_missing_coverage_gives_no_rotation(spark, rotating):
    placed = compensated(spark, rotating, MotionConfig(window_us=35_000, offset_s=-1.0))
    assert placed.where("covered").count() == 0


def test_gyro_lookup_ends_with_the_samples(spark, rotating):
    intervals = rotating[3]
    points = spark.createDataFrame(
        [("s", -0.01), ("s", 0.0), ("s", 0.105), ("s", 0.2), ("s", 0.21)], "stream_id string, time_s double"
    )
    found = imu.gyro_at(points, intervals).toPandas()
    assert sorted(found.time_s) == [0.0, 0.105, 0.2]
    assert (found.gy == RATE[1]).all()


def test_lookup_and_rotation_refuse_gaps(spark):
    times = [0.0, 0.01, 0.02, 0.12, 0.13, 0.14]
    intervals = imu.prepared_imu(imu_table(spark, times, gravity=(0.0, 2.0, 0.0)))
    points = spark.createDataFrame(
        [("s", 0.015), ("s", 0.05), ("s", 0.12), ("s", 0.125)], "stream_id string, time_s double"
    )
    found = imu.orientation_at(points, intervals).orderBy("time_s").toPandas()
    assert list(found.time_s) == [0.015, 0.12, 0.125]
    assert list(found.gap_count) == [0, 1, 1]
    # A start exactly on the first sample after the gap still touches the gap.
    assert list(found.gap_floor) == [0, 0, 1]
    assert found.down.iloc[0].gravity_y == pytest.approx(1.0)


def test_orientation_does_not_depend_on_blocks(spark, monkeypatch):
    samples = imu_table(spark, [i * 0.01 for i in range(300)], gyro=(0.3, -0.7, 0.5))
    whole = imu.imu_intervals(samples).orderBy("t1").toPandas()
    monkeypatch.setattr(imu, "BLOCK_S", 0.5)
    split = imu.imu_intervals(samples).orderBy("t1").toPandas()
    for name in ("b_qw", "b_qx", "b_qy", "b_qz", "a_qw", "gap_count"):
        assert split[name].to_numpy() == pytest.approx(whole[name].to_numpy(), abs=1e-12)


def test_dense_samples_are_cut_into_blocks_by_their_number(spark, monkeypatch):
    rng = np.random.default_rng(8)
    dense = np.unique(np.round(np.concatenate([rng.uniform(3, 5, 900), rng.uniform(0, 1300, 60)]), 6))
    samples = imu_table(spark, dense.tolist(), gyro=(0.3, -0.7, 0.5))
    whole = imu.imu_intervals(samples).orderBy("t1").toPandas()
    monkeypatch.setattr(imu, "BLOCK_ROWS", 50)
    blocks = imu.time_blocks(samples).orderBy("time_s").toPandas()
    assert len(blocks) == len(dense) and blocks.block.is_monotonic_increasing
    slots = np.unique(np.floor(dense / imu.SLOT_S), return_counts=True)[1]
    assert blocks.groupby("block").size().max() <= 50 + slots.max()
    assert blocks.block.nunique() < 30
    split = imu.imu_intervals(samples).orderBy("t1").toPandas()
    assert list(split.t0) == list(whole.t0) and list(split.gap_count) == list(whole.gap_count)
    for name in ("b_qw", "b_qx", "b_qy", "b_qz", "a_qw"):
        assert split[name].to_numpy() == pytest.approx(whole[name].to_numpy(), abs=1e-12)


def test_one_stream_is_many_tasks(spark):
    """With a few of many partitions in use, adaptive execution does not broadcast the stream's start."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        samples = imu_table(spark, (np.arange(4000) * 0.001).tolist(), gyro=(0.3, -0.7, 0.5))
        sizes = [r["count"] for r in samples.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000 and max(sizes) < 1000


def test_covered_rows_alone_are_the_same(spark):
    camera, cfg = simple_camera(50, 64, 48), MotionConfig(window_us=20_000, step_us=10_000)
    events = event_table(spark, [(i * 500, i % 64, i % 48) for i in range(300)])
    times = [i * 0.01 for i in range(16) if i not in (6, 7, 8, 9, 10)]
    intervals = imu.prepared_imu(imu_table(spark, times, gyro=(0.3, -0.7, 0.5), gravity=(0.0, 1.0, 0.0)))
    windows = motion.window_grid(stream_bounds(events), intervals, cfg)
    rotations = motion.window_rotations(windows, intervals, cfg)
    rows = motion.window_events(events, windows, cfg)
    every = motion.compensate(rows, rotations, camera)
    alone = motion.compensate(rows, rotations, camera, covered_only=True)
    want = every.where("covered").collect()
    assert 0 < len(want) < every.count()
    assert sorted(want) == sorted(alone.collect())


@pytest.mark.parametrize("most", [200_000, 0])
def test_slices_are_counted_where_they_lie(spark, monkeypatch, most):
    """The same cells as without slices; events are dealt once, and many rotations are not broadcast."""
    monkeypatch.setattr(motion, "BROADCAST_ROWS", most)
    monkeypatch.setattr(motion, "SLICE_WINDOWS", 4)
    camera, cfg = simple_camera(50, 64, 48), MotionConfig()
    events = materialise(event_table(spark, [(i * 500, i % 64, i % 48) for i in range(600)]))
    samples = imu_table(spark, [i * 0.01 for i in range(40)], gyro=(0.3, -0.7, 0.5), gravity=(0.0, 1.0, 0.0))
    intervals = imu.prepared_imu(samples)
    windows = materialise(motion.window_grid(stream_bounds(events), intervals, cfg))
    rotations = materialise(motion.window_rotations(windows, intervals, cfg))
    plain = motion.compensate(motion.window_events(events, windows, cfg), rotations, camera, covered_only=True)
    rows = motion.window_events(events, windows, cfg, sliced=True)
    turned = motion.compensate(rows, rotations, camera, covered_only=True)
    assert turned.select("slice").distinct().count() > 4
    assert sorted(plain.collect()) == sorted(turned.drop("slice").select(*plain.columns).collect())
    cells = foreground.late_cells(foreground.motion_cells(turned, [*KEYS, "slice"], camera, cfg), [*KEYS, "slice"], cfg)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    try:
        with joined_in_place(spark):
            planned = cells._jdf.queryExecution().executedPlan()
            stages = debug.codegenStringSeq(planned)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    plan = planned.toString()
    assert plan.count("Exchange hashpartitioning(stream_id") == plan.count("REPARTITION_BY_NUM") + 1  # the streams' ranges
    assert plan.count("ShuffledHashJoin") == (0 if most else 1)
    assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) <= 8000


@pytest.mark.parametrize("small", [True, False])
def test_tracker_rotation_fits_the_compiled_method_size(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(motion, "broadcast_if_small", lambda df: df.hint("merge"))
    camera, cfg = simple_camera(50, 64, 48), MotionConfig()
    events = event_table(spark, [(i * 500, i % 64, i % 48) for i in range(600)])
    intervals = imu.prepared_imu(imu_table(spark, [i * 0.01 for i in range(40)], gravity=(0.0, 1.0, 0.0)))
    windows = materialise(motion.window_grid(stream_bounds(events), intervals, cfg))
    rotations = materialise(motion.window_rotations(windows, intervals, cfg))
    turned = motion.compensate(motion.window_events(events, windows, cfg), rotations, camera, covered_only=True)
    cells = foreground.motion_cells(turned, KEYS, camera, cfg)
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = debug.codegenStringSeq(cells._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert 0 < max(sizes) <= 8000


@pytest.mark.parametrize("small", [True, False])
def test_foreground_rotation_fits_the_compiled_method_size(spark, monkeypatch, small):
    """``motion_foreground`` needs the unturned position too, and rows without coverage."""
    if not small:
        monkeypatch.setattr(motion, "broadcast_if_small", lambda df: df.hint("merge"))
    written = []
    monkeypatch.setattr(catalog, "materialise", lambda df: written.append(df) or materialise(df))
    catalog.motion_foreground(spark, "/root/testdata/sf0.001")
    rows = written[-1]
    assert {"ox", "oy", "px", "py"} < set(rows.columns)
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = debug.codegenStringSeq(rows.select("*")._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert 0 < max(sizes) <= 8000


def test_position_outside_the_sensor_is_null(spark):
    camera, cfg = simple_camera(50, 64, 48), MotionConfig(window_us=20_000, step_us=10_000)
    places = [(-1, 5), (3, -1), (64, 5), (3, 48), (0, 0), (63, 47), (30, 20)]
    events = event_table(spark, [(i * 500, *places[i % len(places)]) for i in range(300)])
    still = imu_table(spark, [i * 0.01 for i in range(16) if i not in (6, 7, 8, 9, 10)])
    intervals = imu.prepared_imu(still)
    windows = motion.window_grid(stream_bounds(events), intervals, cfg)
    rotations = motion.window_rotations(windows, intervals, cfg)
    turned = motion.compensate(motion.window_events(events, windows, cfg), rotations, camera, with_original=True)
    rows = turned.collect()
    assert {r.covered for r in rows} == {True, False}
    assert set(turned.columns) >= {"ox", "oy", "px", "py"} and not [c for c in turned.columns if c.startswith("__")]
    for r in rows:
        inside = 0 <= r.x < 64 and 0 <= r.y < 48
        want = (pytest.approx(r.x), pytest.approx(r.y)) * 2 if inside else (None,) * 4
        assert (r.ox, r.oy, r.px, r.py) == want


@pytest.mark.parametrize("name", ["compensated_points", "turned_foreground"])
def test_windows_reach_the_latest_time_of_a_log_numbered_out_of_order(spark, tmp_path, name):
    """The log twice: the copy's keys follow, its times are turned round by a quarter of the span."""
    (tmp_path / "log").mkdir()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(
        f"""COPY (
          WITH e AS (FROM '/root/testdata/sf0.01/events.parquet'),
               b AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) - low + 1 AS span, max(event_id) + 1 AS n FROM e)
          SELECT e.* REPLACE (event_id + k * n AS event_id,
                 make_timestamp(low + (epoch_us(ts) - low + k * (span // 4)) % span)::TIMESTAMP AS ts)
          FROM e, b, range(2) r(k)) TO '{tmp_path}/log/events.parquet' (FORMAT parquet)"""
    )
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/log/events.parquet'")
    got = catalog.QUERIES[name](spark, f"{tmp_path}/log").toPandas()
    assert difference(got, con.execute(catalog_sql.ORACLE[name]).df()) is None


def test_running_products_equal_one_by_one():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 100, 1001):
        turns = rng.normal(size=(n, 4))
        turns /= np.linalg.norm(turns, axis=1)[:, None]
        before = held = tuple(rng.normal(size=4))
        want = []
        for turn in turns.tolist():
            held = g.quaternion_product(held, turn)
            want.append(held)
        assert imu.running_products(turns, before) == pytest.approx(np.array(want), abs=1e-12)


def test_orientation_sends_no_struct_to_python_and_sorts_no_block_ends(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(imu, "materialise", lambda df: plans.append(df) or materialise(df))
    samples = materialise(imu_table(spark, [i * 0.01 for i in range(40)], gyro=(0.3, -0.7, 0.5)))
    linked = imu.imu_intervals(samples)
    local = plans[1]
    assert {"d_qw", "o_qw", "block"} < set(local.columns)
    assert not [f.name for f in local.schema if isinstance(f.dataType, T.StructType)]
    for df in (local, linked):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_imu_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("﻿ gz,timestamp , gx,gy,note\n3,10.5,1,2,a\n6,10.0,4,5,b\n9,10.5,7,8,c\n")
    rows = read_imu_csv(spark, str(good)).orderBy("time_s").collect()
    assert [(r.time_s, r.gx, r.gy, r.gz) for r in rows] == [(0.0, 4.0, 5.0, 6.0), (0.5, 1.0, 2.0, 3.0)]
    bad = tmp_path / "bad.csv"
    bad.write_text("timestamp,gx,gy,gz\n0,NaN,0,0\n1,0,0,0\n")
    with pytest.raises(Exception, match="invalid IMU sample"):
        read_imu_csv(spark, str(bad)).collect()
    short = tmp_path / "short.csv"
    short.write_text("timestamp,gx,gy,gz\n1,0,0,0\n1,0,0,0\n")
    with pytest.raises(Exception, match="at least two"):
        read_imu_csv(spark, str(short)).collect()
    wrong = tmp_path / "wrong.csv"
    wrong.write_text("time,gx,gy,gz\n1,0,0,0\n")
    with pytest.raises(InvalidConfig):
        read_imu_csv(spark, str(wrong))
