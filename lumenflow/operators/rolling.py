"""Rolling detection: ticks, window members, continuity and the reported detection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from lumenflow.config import ClusterConfig
from lumenflow.functions.circle import fit_circles
from lumenflow.operators.clusters import cell_of, confidence, count_cells, eligible, merge_cells
from lumenflow.operators.components import connected_cells
from lumenflow.plans.hopping import ceil_div, explode_hops, floor_div
from lumenflow.plans.lineage import materialise
from lumenflow.plans.ordered import scan_ordered, spread
from lumenflow.plans.scan import running
from lumenflow.plans.thin import evenly
from lumenflow.plans.sized import broadcast_if_small

#: ``tick_us`` follows from the tick; as a key it travels along for free.
KEYS = ["stream_id", "tick", "tick_us"]
#: A window's members are spread over this many join keys, so a busy window is no hot key.
SALT = 16


def stream_bounds(events: DataFrame) -> DataFrame:
    """Per stream: time of the first and last event in stream order, and the last ``seq``."""
    return materialise(
        events.groupBy("stream_id").agg(
            F.min_by("timestamp_us", "seq").alias("origin_us"),
            F.max_by("timestamp_us", "seq").alias("last_us"),
            F.max("seq").alias("last_seq"),
        )
    )


def with_origin(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Attach the bounds of the event's stream; the small side is checked before a broadcast."""
    return events.join(broadcast_if_small(bounds), "stream_id")


def rolling_ticks(events: DataFrame, cfg: ClusterConfig, bounds: DataFrame | None = None) -> DataFrame:
    """Ticks ``origin + k * step`` that can still see events, with the event that fires each.

    A tick fires on the first event at or after it. Older events have been trimmed to that
    event's time minus the window by then, so a tick that fires late sees a shorter window.
    """
    bounds = bounds if bounds is not None else stream_bounds(events)
    since = F.col("timestamp_us") - F.col("origin_us")
    heads = (
        with_origin(events, bounds)
        .withColumn("k", floor_div(since, cfg.step_us))
        .where("k >= 1")
        .groupBy("stream_id", "k")
        .agg(
            F.min("seq").alias("fired_seq"),
            F.min_by("timestamp_us", "seq").alias("fired_us"),
            F.first("origin_us").alias("origin_us"),
        )
    )
    # Ticks older than the trimmed window are empty, so each head claims only a few.
    oldest = ceil_div(F.col("fired_us") - cfg.window_us - F.col("origin_us"), cfg.step_us)
    return (
        heads.withColumn(
            "tick", F.explode(F.sequence(F.greatest(oldest, F.lit(1).cast("long")), F.col("k")))
        )
        .groupBy("stream_id", "tick")
        .agg(
            F.min_by("fired_us", "fired_seq").alias("fired_us"),
            F.min("fired_seq").alias("fired_seq"),
            F.first("origin_us").alias("origin_us"),
        )
        .select(
            "stream_id",
            "tick",
            (F.col("origin_us") + F.col("tick") * cfg.step_us).alias("tick_us"),
            "fired_us",
            "fired_seq",
        )
    )


def rolling_members(events: DataFrame, cfg: ClusterConfig, mode: str = "exact") -> DataFrame:
    """Events of every tick's window, plus one closing window per stream at its last event.

    ``mode="exact"`` keeps what a tick really sees (see ``rolling_ticks``); ``"ideal"`` takes the
    full ``[tick - window, tick]``. The closing window has the tick number after the last one.
    """
    bounds = stream_bounds(events)
    t = F.col("timestamp_us")
    placed = with_origin(events, bounds)
    ticks = floor_div(F.col("last_us") - F.col("origin_us"), cfg.step_us)
    hops = explode_hops(
        placed, t - F.col("origin_us"), cfg.window_us, cfg.step_us, first=1, last=ticks, name="tick"
    ).withColumn("tick_us", F.col("origin_us") + F.col("tick") * cfg.step_us)
    if mode == "exact":
        fired = (
            rolling_ticks(events, cfg, bounds)
            .select("stream_id", "tick", "fired_us", "fired_seq")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        )
        hops = (
            hops.withColumn("salt", F.pmod("seq", F.lit(SALT)).cast("int"))
            .join(fired, ["stream_id", "tick", "salt"])
            .where((t >= F.col("fired_us") - cfg.window_us) & (F.col("seq") <= F.col("fired_seq")))
        )
    elif mode != "ideal":
        raise ValueError(f"unknown mode {mode!r}")
    closing = (
        placed.where(t >= F.col("last_us") - cfg.window_us)
        .withColumn("tick", ticks + 1)
        .withColumn("tick_us", F.col("last_us"))
    )
    columns = [*events.columns, "tick", "tick_us"]
    return hops.select(*columns).unionByName(closing.select(*columns))


def _continuity():
    """Follow one stream segment: prefer clusters near the previous detection."""
    previous = None

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        nonlocal previous
        tick = rows["tick"].to_numpy()
        n = rows["event_count"].to_numpy(dtype=float)
        x, y = rows["centroid_x"].to_numpy(), rows["centroid_y"].to_numpy()
        starts = np.flatnonzero(np.r_[True, tick[1:] != tick[:-1]])
        chosen = np.empty(len(starts), dtype=np.int64)
        for i, (a, b) in enumerate(zip(starts, np.r_[starts[1:], len(tick)])):
            score = n[a:b]
            if previous is not None:
                score = score / (1 + np.hypot(x[a:b] - previous[0], y[a:b] - previous[1]) / 100)
            best = a + int(np.argmax(score))
            previous = (x[best], y[best])
            chosen[i] = best
        return rows.iloc[chosen]

    return step


def follow_best(candidates: DataFrame) -> DataFrame:
    """One cluster per tick: most events, damped by the distance to the previous choice.

    A tick with a single candidate has the same outcome whatever came before, so the stream is cut
    there and segments are followed in parallel, in bounded memory each.
    """
    candidates = materialise(candidates)
    lone = candidates.groupBy("stream_id", "tick").agg((F.count(F.lit(1)) == 1).cast("long").alias("lone"))
    segments = running(
        lone,
        ["stream_id"],
        "tick",
        floor_div(F.col("tick"), 1 << 16),
        total={"segment": F.col("lone")},
        include_current=True,
    ).select("stream_id", "tick", "segment")
    rows = candidates.join(segments, ["stream_id", "tick"])
    schema = T.StructType([f for f in rows.schema.fields])
    return scan_ordered(rows, ["stream_id", "segment"], ["tick", "label"], _continuity, schema).drop(
        "segment"
    )


def rolling_detections(
    events: DataFrame,
    cfg: ClusterConfig = ClusterConfig(),
    sensor: tuple[int, int] | None = None,
    mode: str = "exact",
) -> DataFrame:
    """The rolling tracker: one detection per tick that has an eligible cluster."""
    members = rolling_members(events, cfg, mode)
    cells = count_cells(members, KEYS, cfg.cell_size)
    grid = tuple(-(-side // cfg.cell_size) for side in sensor) if sensor else None
    labelled = materialise(connected_cells(cells, KEYS, grid))
    best = follow_best(eligible(merge_cells(labelled, KEYS), cfg))
    detections = best.select(
        "stream_id",
        "tick",
        F.col("tick_us").alias("timestamp_us"),
        F.greatest(F.col("tick_us") - cfg.window_us, F.lit(0)).alias("window_start_us"),
        F.col("tick_us").alias("window_end_us"),
        "label",
        "centroid_x",
        "centroid_y",
        "min_x",
        "min_y",
        "max_x",
        "max_y",
        "event_count",
        "cell_count",
        confidence(cfg).alias("confidence"),
    )
    if not cfg.circle_fit:
        return detections
    detections = materialise(detections)
    circles = circle_fits(members, labelled, detections, cfg)
    return detections.join(circles, ["stream_id", "tick"], "left")


def circle_fits(
    members: DataFrame, labelled: DataFrame, detections: DataFrame, cfg: ClusterConfig
) -> DataFrame:
    """Robust circle per detection, from ``cfg.circle_points`` members spread over (cell, seq) order.

    A member's rank is the count of its cluster's earlier cells plus its rank inside its cell, so
    no window is sorted as a whole. Only those members travel on.
    """
    keys = ["stream_id", "tick"]
    earlier = (
        Window.partitionBy(*keys).orderBy("cx", "cy").rowsBetween(Window.unboundedPreceding, -1)
    )
    chosen = detections.select(*keys, "label", "event_count")
    cells = (
        labelled.join(chosen, [*keys, "label"])
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .select(*keys, "cx", "cy", "before", "event_count")
    )
    inside = Window.partitionBy(*keys, "cx", "cy").orderBy("seq")
    points = (
        members.withColumn("cx", cell_of("x", cfg.cell_size))
        .withColumn("cy", cell_of("y", cfg.cell_size))
        .join(cells, [*keys, "cx", "cy"])
        .withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
        .where(evenly(F.col("rank"), F.col("event_count"), cfg.circle_points))
    )
    return (
        spread(points.select(*keys, "rank", "x", "y"), keys)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "x", "y"))).alias("points"))
        .select(
            *keys,
            fit_circles(cfg.circle_tolerance_px)(
                F.col("points.x").cast("array<double>"), F.col("points.y").cast("array<double>")
            ).alias("circle"),
        )
        .where("circle.center_x is not null")
    )
