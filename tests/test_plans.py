import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import event_table
from lumenflow.operators import clusters, components, proposals
from lumenflow.plans.frames import last_rows, recent_rows
from lumenflow.plans.hopping import explode_hops
from lumenflow.plans.ordered import scan_ordered
from lumenflow.plans.scan import running
from lumenflow.plans.sized import broadcast_if_small
from lumenflow.sinks import tables


@pytest.fixture()
def small_batches(spark):
    """Arrow batches that end in the middle of groups and updates."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 800
    frame = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 6, n)),
            "seq": np.arange(n) * 3,
            "v": rng.integers(-50, 50, n),
            "flag": rng.random(n) < 0.2,
        }
    )
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_does_not_depend_on_blocks(table, inclusive):
    frame, df = table
    got = running(
        df, ["k"], "seq", F.floor(F.col("seq") / 100),
        last={"seen": F.when(F.col("flag"), F.col("v"))}, total={"sum": F.col("v")}, peak={"top": F.col("v")},
        include_current=inclusive,
    ).toPandas().sort_values("seq")
    shift = 0 if inclusive else 1
    by = frame.groupby("k")
    seen = frame.v.where(frame.flag).groupby(frame.k).ffill().groupby(frame.k).shift(shift)
    assert np.allclose(got.seen.to_numpy(dtype=float), seen, equal_nan=True)
    assert np.allclose(got["sum"].to_numpy(dtype=float), by.v.cumsum().groupby(frame.k).shift(shift).fillna(0))
    assert np.allclose(got.top.to_numpy(dtype=float), by.v.cummax().groupby(frame.k).shift(shift), equal_nan=True)


def test_running_keeps_structs_with_null_fields(table):
    frame, df = table
    odd = F.when(F.col("v") % 2 == 0, F.col("v"))
    got = running(
        df, ["k"], "seq", F.floor(F.col("seq") / 100),
        last={"s": F.when(F.col("flag"), F.struct("seq", odd.alias("even"), F.lit("x").alias("name")))},
    )
    assert got.schema["s"].dataType.names == ["seq", "even", "name"]
    held = {}
    for r, now in zip(got.orderBy("seq").collect(), frame.itertuples(), strict=True):
        assert (r.s and tuple(r.s)) == held.get(now.k)
        if now.flag:
            held[now.k] = (now.seq, now.v if now.v % 2 == 0 else None, "x")


def test_frames_are_complete_across_chunks(table, monkeypatch):
    frame, df = table
    monkeypatch.setattr("lumenflow.plans.frames.CHUNK_ROWS", 16)
    got = last_rows(df, ["k"], "seq", F.floor(F.col("seq") / 200), 5, {"held": F.col("v")}).toPandas()
    want = {s: g.v.tolist()[max(i - 4, 0) : i + 1] for _, g in frame.groupby("k") for i, s in enumerate(g.seq)}
    assert {r.seq: list(r.held) for r in got.itertuples()} == want


def test_ordered_scan_keeps_updates_together(spark, table, small_batches):
    frame, df = table

    def machine():
        total = 0

        def step(rows):
            nonlocal total
            out = []
            for tick, part in rows.groupby("tick", sort=False):
                total += int(part.v.sum())
                out.append((int(part.k.iloc[0]), int(tick), total, len(part)))
            return pd.DataFrame(out, columns=["k", "tick", "total", "rows"])

        return step

    ticked = df.withColumn("tick", F.floor(F.col("seq") / 50))
    got = scan_ordered(ticked, ["k"], ["tick", "seq"], machine, "k long, tick long, total long, rows long").toPandas()
    grouped = frame.assign(tick=frame.seq // 50).groupby(["k", "tick"]).v
    assert len(got) == grouped.ngroups
    want = grouped.sum().groupby("k").cumsum()
    assert {(r.k, r.tick): r.total for r in got.itertuples()} == want.to_dict()
    assert {(r.k, r.tick): r.rows for r in got.itertuples()} == grouped.size().to_dict()


def test_components_and_proposals_across_batches(spark, small_batches):
    rng = np.random.default_rng(4)
    rows = [(int(t), int(x), int(y)) for t, x, y in zip(rng.integers(0, 5, 900), rng.integers(0, 30, 900), rng.integers(0, 30, 900))]
    events = event_table(spark, rows).withColumn("window_id", F.col("timestamp_us"))
    keys = ["stream_id", "window_id"]
    cells = clusters.count_cells(events, keys, 1)
    small = components.connected_cells(cells, keys, (30, 30)).select("window_id", "cx", "cy", "label").collect()
    pixels = events.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    few = proposals.propose(pixels, proposals.ProposalLimits(cell_px=1, min_events=5)).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    large = components.connected_cells(cells, keys, (30, 30)).select("window_id", "cx", "cy", "label").collect()
    many = proposals.propose(pixels, proposals.ProposalLimits(cell_px=1, min_events=5)).collect()
    assert sorted(small) == sorted(large) and sorted(few) == sorted(many) and len(few) > 5


def test_proposals_remove_boxes_and_prefer_the_earliest(spark):
    def block(x0, y0, seq):
        return [("s", 0, x0 + i % 6, y0 + i // 6, 1, seq + i) for i in range(24)]

    # Two equal clusters, and scattered pixels inside the first one's box.
    rows = [*block(100, 100, 50), *block(10, 10, 0), ("s", 0, 12, 11, 5, 90)]
    rows = [r for i, r in enumerate(rows) if r[2:4] != (12, 11) or i == len(rows) - 1]
    pixels = spark.createDataFrame(rows, "stream_id string, window_id long, x int, y int, n long, first_seq long")
    found = proposals.propose(pixels).orderBy("rank").collect()
    assert [(r.rank, r.event_count, r.min_x, r.max_x) for r in found] == [(1, 28, 10, 15), (2, 24, 100, 105)]
    tied = pixels.where("n = 1").unionByName(pixels.where("n = 5").withColumn("n", F.lit(1).cast("long")))
    assert [r.min_x for r in proposals.propose(tied).orderBy("rank").collect()] == [10, 100]


def test_broadcast_only_when_counted_small(spark):
    df = spark.range(10)
    assert "hint" in broadcast_if_small(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in broadcast_if_small(df, 9)._jdf.queryExecution().logical().toString().lower()


def test_written_events_are_pruned_by_time(spark, tmp_path):
    path = str(tmp_path / "events")
    tables.write_events(event_table(spark, [(i * 10, i % 50, i % 40) for i in range(500)]), path)
    back = spark.read.parquet(path).where("stream_id = 's' and timestamp_us between 100 and 200")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp_us,100)" in plan and "stream_id" in plan.split("PartitionFilters")[1]
    assert back.count() == 11


@pytest.mark.parametrize("window,step", [(4000, 2000), (900, 1000), (5000, 700), (0, 300)])
def test_panes_equal_a_row_per_event_and_window(spark, window, step):
    rng = np.random.default_rng(window)
    rows = [(int(t), int(x), int(y)) for t, x, y in zip(np.sort(rng.integers(0, 400_000, 1500)), rng.integers(0, 9, 1500), rng.integers(0, 9, 1500))]
    rows += [(k * step, 3, 3) for k in range(40)]
    events = event_table(spark, rows)
    at = F.col("timestamp_us")
    got = clusters.hopping_cells(events, at, window, step, 2, first=1, last=F.lit(250))
    hops = explode_hops(events, at, window, step, first=1, last=F.lit(250))
    want = clusters.count_cells(hops, ["stream_id", "window_id"], 2)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    # Panes are shuffled twice; nothing is shuffled once they have become windows.
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2


def test_frames_of_time_are_complete_across_chunks(spark, monkeypatch):
    monkeypatch.setattr("lumenflow.plans.frames.CHUNK_SPANS", 2)
    rng = np.random.default_rng(12)
    rows = [(int(k), int(t), int(v) if v % 3 else None) for k, t, v in zip(rng.integers(0, 3, 500), rng.integers(-900, 900, 500), rng.integers(0, 99, 500))]
    df = spark.createDataFrame([*rows, (1, None, 5)], "k int, at long, v int")
    got = recent_rows(df, ["k"], "at", 40, {"held": F.col("v")}).collect()
    want = sorted((k, t, sorted(v for j, s, v in rows if j == k and t - 40 <= s <= t and v is not None)) for k, t, _ in rows)
    assert sorted((r.k, r.at, sorted(r.held)) for r in got) == want
