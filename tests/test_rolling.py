import math
from collections import defaultdict

import numpy as np
import pytest

from fixtures import event_table
from lumenflow.config import ClusterConfig, InvalidConfig
from lumenflow.functions.circle import fit_circle
from lumenflow.functions.label import connected
from lumenflow.operators import clusters, components, rolling


def brute_windows(rows, window, step):
    """Members of every tick, replayed event by event."""
    held, tick, k, out = [], None, 0, []
    for seq, (t, *_) in enumerate(rows):
        held = [s for s in [*held, seq] if rows[s][0] >= t - window]
        tick = rows[0][0] + step if tick is None else tick
        while t >= tick:
            k += 1
            out.append((k, sorted(s for s in held if tick - window <= rows[s][0] <= tick)))
            tick += step
    last = rows[-1][0]
    out.append((k + 1, sorted(s for s in held if rows[s][0] >= last - window)))
    return {k: m for k, m in out if m}


@pytest.mark.parametrize("seed", range(4))
def test_members_match_a_replay(spark, seed):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.choice([0, 1, 5, 40, 300], size=200, p=[0.3, 0.3, 0.25, 0.1, 0.05])) + 100
    rows = [(int(v), 1, 1) for v in t]
    cfg = ClusterConfig(window_us=60, step_us=20)
    got: dict[int, list[int]] = {}
    for r in rolling.rolling_members(event_table(spark, rows), cfg).select("tick", "seq").collect():
        got.setdefault(r.tick, []).append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == brute_windows(rows, 60, 20)


def plain_best(rows, members, cfg):
    """The largest eligible cluster of some events: count, bounds, centroid and confidence."""
    cells = {s: (rows[s][1] // cfg.cell_size, rows[s][2] // cfg.cell_size) for s in members}
    labels = brute_components(set(cells.values()))
    groups = defaultdict(list)
    for s, cell in cells.items():
        groups[labels[cell]].append(s)
    best = None
    for label, own in groups.items():
        x, y = [rows[s][1] for s in own], [rows[s][2] for s in own]
        if len(own) >= cfg.min_events and len({cells[s] for s in own}) >= cfg.min_cells:
            area = (max(x) - min(x) + 1) * (max(y) - min(y) + 1)
            sure = min(len(own) / cfg.min_events, 1) * math.sqrt(min(len(own) / area, 1))
            found = (-len(own), label), (len(own), min(x), min(y), max(x), max(y), sum(x) / len(x), sum(y) / len(y), sure)
            best = found if best is None or found < best else best
    return best and best[1]


@pytest.mark.parametrize("seed", [51, 52, 53])
def test_lone_windows_report_their_largest_cluster(spark, seed):
    """The first detection and, without continuity, the best cluster of every window."""
    rng = np.random.default_rng(seed)
    rows, cfg = [], ClusterConfig(400, 500, 3, min_events=6, min_cells=3, circle_fit=False)
    for burst in range(5):
        spots = rng.integers([5, 5], [150, 110], (3, 2))
        for spot, n in zip(spots, rng.permutation([4, 13, 30])):
            rows += [(500 * burst + int(t), *map(int, spot + rng.integers(0, 9, 2))) for t in rng.integers(130, 480, n)]
    rows = [(0, 170, 120), *sorted(rows), (2500, 170, 120)]
    events = event_table(spark, rows)
    found = {r.tick: r for r in rolling.rolling_detections(events, cfg, (176, 128)).collect()}
    windows = {k: m for k, m in brute_windows(rows, 400, 500).items() if plain_best(rows, m, cfg)}
    assert set(found) == set(windows)
    first = found[min(found)]
    got = (first.event_count, first.min_x, first.min_y, first.max_x, first.max_y, first.centroid_x, first.centroid_y, first.confidence)
    assert got == pytest.approx(plain_best(rows, windows[min(found)], cfg))
    grouped = clusters.window_clusters(rolling.rolling_members(events, cfg), rolling.KEYS, cfg, (176, 128))
    best = clusters.best_cluster(grouped, rolling.KEYS, cfg).collect()
    assert {r.tick for r in best} == set(windows)
    for r in best:
        got = (r.event_count, r.min_x, r.min_y, r.max_x, r.max_y, r.centroid_x, r.centroid_y, r.confidence)
        assert got == pytest.approx(plain_best(rows, windows[r.tick], cfg))


def test_continuity_prefers_the_previous_place(spark):
    rows = []
    for k in range(1, 5):
        # A steady cluster on the left; from the third tick on a slightly larger one far away.
        rows += [(k * 100 - 50, 10 + i % 3, 10 + i // 3) for i in range(9)]
        if k >= 3:
            rows += [(k * 100 - 50, 400 + i % 4, 10 + i // 4) for i in range(11)]
        # A lone event on the tick fires it.
        rows.append((k * 100, 600, 400))
    cfg = ClusterConfig(90, 100, 1, min_events=5, min_cells=3, circle_fit=False)
    events = event_table(spark, [(0, 600, 400), *rows])
    found = rolling.rolling_detections(events, cfg, (640, 480)).orderBy("tick").collect()
    assert [(r.event_count, r.centroid_x) for r in found][:4] == [(9, 11.0)] * 4


def least_squares_circle(x, y):
    """Centre and radius by the linear form x^2 + y^2 = 2 a x + 2 b y + c."""
    table = np.column_stack([2 * x, 2 * y, np.ones(len(x))])
    a, b, c = np.linalg.lstsq(table, x * x + y * y, rcond=None)[0]
    return a, b, math.sqrt(c + a * a + b * b)


@pytest.mark.parametrize("seed", range(5))
def test_circle_fit_ignores_what_is_off_the_ring(seed):
    rng = np.random.default_rng(60 + seed)
    centre, size = rng.uniform([60, 60], [240, 180]), rng.uniform(12, 45)
    angle = rng.permutation(60)[:44] * math.tau / 60
    x = centre[0] + size * np.cos(angle) + rng.normal(0, 0.3, 44)
    y = centre[1] + size * np.sin(angle) + rng.normal(0, 0.3, 44)
    want = least_squares_circle(x, y)
    stray = rng.uniform(-0.4, 0.4, (3, 2)) * size + centre
    got = fit_circle(np.append(x, stray[:, 0]), np.append(y, stray[:, 1]), 2.0)
    assert np.abs(np.array(got[:3]) - want).max() < 0.6
    assert fit_circle(x[:4], y[:4], 2.0)[0] is None


def test_ring_detection_has_a_circle(spark):
    rng = np.random.default_rng(66)
    centre, size = rng.uniform([70, 60], [120, 90]), rng.uniform(18, 28)
    angle = np.sort(rng.random(150)) * math.tau
    ring = [(int(i * 6), round(centre[0] + size * math.cos(v)), round(centre[1] + size * math.sin(v))) for i, v in enumerate(angle)]
    cfg = ClusterConfig(1500, 1000, 3, min_events=30, min_cells=5)
    events = event_table(spark, [*ring, (1000, 300, 200)])
    row = rolling.rolling_detections(events, cfg, (320, 240)).orderBy("tick").first()
    want = least_squares_circle(*np.array([r[1:] for r in ring], float).T)
    got = (row.circle.center_x, row.circle.center_y, row.circle.radius_px)
    assert row.event_count == 150 and np.abs(np.subtract(got, want)).max() < 1


def brute_components(cells):
    left, labels = set(cells), {}
    for start in sorted(cells):
        if start not in left:
            continue
        group, stack = [], [start]
        left.discard(start)
        while stack:
            x, y = stack.pop()
            group.append((x, y))
            for n in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if n in left:
                    left.discard(n)
                    stack.append(n)
        low = min(x * components.LABEL_STRIDE + y for x, y in group)
        labels |= {c: low for c in group}
    return labels


@pytest.mark.parametrize("tile", [None, 4])
def test_components_match_flood_fill(spark, tile):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for w in range(6):
        cells = {(int(a), int(b)) for a, b in rng.integers(0, 24, size=(220, 2))}
        if w == 0:
            # A spiral-like snake that crosses every tile.
            cells = {(x, y) for y in range(0, 24, 2) for x in range(24)} | {(23 if y % 4 == 1 else 0, y) for y in range(1, 24, 2)}
        rows += [("s", w, x, y) for x, y in cells]
        want |= {(w, x, y): v for (x, y), v in brute_components(cells).items()}
    frame = spark.createDataFrame(rows, "stream_id string, window_id long, cx int, cy int")
    grid = (24, 24) if tile is None else None
    found = components.connected_cells(frame, ["stream_id", "window_id"], grid, tile).collect()
    assert {(r.window_id, r.cx, r.cy): r.label for r in found} == want


def test_label_kernel_keeps_groups_apart():
    first = connected(np.array([0, 1, 1]), np.array([5, 5, 6]), np.array([5, 5, 6]))
    assert first.tolist() == [0, 1, 1]


def test_settings_are_validated():
    for change in ({"window_us": 0}, {"step_us": 0}, {"cell_size": 0}, {"circle_tolerance_px": 0}):
        with pytest.raises(InvalidConfig):
            ClusterConfig(**change)
