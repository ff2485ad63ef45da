import numpy as np
import pytest

from fixtures import event_table
from lumenflow.config import BackgroundConfig, InvalidConfig, PolarityConfig, StaticConfig
from lumenflow.operators import filters


def brute_background(rows, radius, window):
    last, out = {}, []
    for t, x, y, *_ in rows:
        near = [
            last.get((x + dx, y + dy))
            for dx in range(-radius, radius + 1)
            for dy in range(-radius, radius + 1)
            if (dx or dy) and dx * dx + dy * dy <= radius * radius
        ]
        out.append(any(v is not None and t - v <= window for v in near))
        last[x, y] = t
    return out


def brute_static(rows, cfg):
    cells, swept, out = {}, 0, []
    for t, x, y, *_ in rows:
        idle = cfg.inactive_after_us
        if idle is not None and t - swept > idle:
            cells = {k: v for k, v in cells.items() if t - v[1] <= idle}
            swept = t
        first, _, n = cells.get((x // cfg.cell_size, y // cfg.cell_size), (t, t, 0))
        cells[x // cfg.cell_size, y // cfg.cell_size] = (first, t, n + 1)
        out.append(t - first >= cfg.stable_after_us and n + 1 >= cfg.min_events)
    return out


def random_rows(seed, count=1500, width=40, height=30, hot=0.35):
    """Ordered events with ties and gaps; a third of them on one pixel."""
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.choice([0, 3, 40, 900, 4000], size=count, p=[0.3, 0.4, 0.2, 0.07, 0.03]))
    x, y = rng.integers(0, width, count), rng.integers(0, height, count)
    pinned = rng.random(count) < hot
    return [(int(a), 7 if p else int(b), 9 if p else int(c)) for a, b, c, p in zip(t, x, y, pinned)]


def test_neighbour_support(spark):
    cfg = BackgroundConfig(window_us=1000)
    near = event_table(spark, [(0, 10, 10), (500, 11, 10)])
    late = event_table(spark, [(0, 10, 10), (2000, 11, 10)])
    assert [r.supported for r in filters.background_flags(near, cfg).orderBy("seq").collect()] == [False, True]
    assert [r.supported for r in filters.background_flags(late, cfg).orderBy("seq").collect()] == [False, False]


@pytest.mark.parametrize("seed", [1, 2])
def test_background_matches_brute_force_across_tiles_and_slices(spark, seed):
    rows = random_rows(seed)
    cfg = BackgroundConfig(radius_px=2, window_us=300, tile_px=8, slice_windows=3)
    flags = filters.background_flags(event_table(spark, rows), cfg).orderBy("seq").collect()
    assert [r.supported for r in flags] == brute_background(rows, 2, 300)


def test_static_cell_is_rejected(spark):
    cfg = StaticConfig(cell_size=4, stable_after_us=1000, min_events=3)
    rows = event_table(spark, [(0, 10, 10), (500, 11, 11), (1000, 10, 10)])
    assert [r.is_static for r in filters.static_flags(rows, cfg).orderBy("seq").collect()] == [False, False, True]


@pytest.mark.parametrize("idle", [None, 5000])
def test_static_matches_brute_force_across_blocks(spark, idle):
    rows = random_rows(3)
    cfg = StaticConfig(4, 2000, 12, idle, block_rows=64)
    flags = filters.static_flags(event_table(spark, rows), cfg).orderBy("seq").collect()
    want = brute_static(rows, cfg)
    assert any(want) and not all(want)
    assert [r.is_static for r in flags] == want


def test_both_sweep_chains_agree(spark):
    events = event_table(spark, random_rows(4, count=600))
    once = filters.cleanup_instants(events, 3000)
    doubled = filters.cleanup_instants(events, 3000, single_pass_times=0)
    want = sorted(r.cleanup_us for r in once.collect())
    assert len(want) > 5
    assert sorted(r.cleanup_us for r in doubled.collect()) == want


def test_polarity_mask_clip_and_order(spark):
    events = event_table(spark, [(0, 1, 1, True), (10, 2, 2, False), (20, 3, 3, True)])
    kept = filters.polarity_filter(events, PolarityConfig("on")).collect()
    # Inversion is on by default.
    assert [r.seq for r in kept] == [1]
    assert filters.polarity_filter(events, PolarityConfig("+", invert=False)).count() == 2
    assert [r.seq for r in filters.mask_pixels(events, [(2, 2), (9, 9)]).orderBy("seq").collect()] == [0, 2]
    assert filters.clip_range(events, 5, 10).count() == 1
    assert filters.time_decreases(events).isEmpty()
    back = event_table(spark, [(0, 1, 1), (10, 1, 1), (5, 1, 1)])
    assert [r.seq for r in filters.time_decreases(back, block_rows=2).collect()] == [2]


def test_rejected_events_do_not_reach_later_filters(spark):
    rows = [(0, 5, 5, True), (10, 6, 5, False), (20, 6, 6, True)]
    accept = filters.configured(PolarityConfig("positive", invert=False), BackgroundConfig(window_us=15))
    flags = filters.accepted_flags(event_table(spark, rows), accept).orderBy("seq").collect()
    # The only recent neighbour of the last event was removed by the polarity filter.
    assert [r.accepted for r in flags] == [False, False, False]


def test_settings_are_validated():
    for build in (
        lambda: BackgroundConfig(window_us=0),
        lambda: BackgroundConfig(window_us=10, cleanup_after_us=5),
        lambda: StaticConfig(cell_size=0),
        lambda: PolarityConfig("sideways"),
    ):
        with pytest.raises(InvalidConfig):
            build()


def test_background_shuffles_once(spark):
    plan = filters.background_flags(event_table(spark, [(0, 1, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_background_sorts_each_event_once(spark):
    """Rows are not multiplied by their neighbours, and batches may end anywhere in a tile."""
    rows = random_rows(5)
    cfg = BackgroundConfig(radius_px=2, window_us=300, tile_px=16, slice_windows=8)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        flags = filters.background_flags(event_table(spark, rows), cfg)
        got = [r.supported for r in flags.orderBy("seq").collect()]
    finally:
        spark.conf.set(name, before)
    assert got == brute_background(rows, 2, 300)
    plan = flags._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Sort ") : plan.index("Exchange hashpartitioning")]
    assert "Generate" not in below and plan.count("Generate explode") <= 3
