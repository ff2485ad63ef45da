"""Streaming filters with the semantics of ``lumenflow.operators.filters``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumenflow.config import BackgroundConfig, StaticConfig
from lumenflow.plans.hopping import floor_div
from lumenflow.streaming.ordered import scan_stream

FLAG_TYPE = "stream_id string, seq long, timestamp_us long, x int, y int, polarity boolean, {} boolean"
COLUMNS = ["stream_id", "seq", "timestamp_us", "x", "y", "polarity"]


class TileActivity:
    """Last event time per pixel of one tile and its halo."""

    def __init__(self, cfg: BackgroundConfig):
        self.cfg = cfg
        side, r = cfg.tile_px, cfg.radius_px
        self.side = side + 2 * r
        # Every asked neighbourhood of a home pixel fits inside the padded tile.
        self.last = np.full(self.side * self.side, np.iinfo(np.int64).min // 2)
        dy, dx = np.mgrid[-r : r + 1, -r : r + 1]
        disc = (dx * dx + dy * dy <= r * r) & ((dx != 0) | (dy != 0))
        self.steps = (dy[disc] * self.side + dx[disc]).tolist()

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        side, r, n = self.cfg.tile_px, self.cfg.radius_px, len(rows)
        px = rows["x"].to_numpy() - rows["__tx"].to_numpy() * side + r
        py = rows["y"].to_numpy() - rows["__ty"].to_numpy() * side + r
        home = (px >= r) & (px < side + r) & (py >= r) & (py < side + r)
        times, pixel = rows["timestamp_us"].to_numpy(), py.astype(np.int64) * self.side + px
        # Pixel and place in the batch as one number: the row before (pixel, i) is that pixel's newest.
        place = np.arange(n, dtype=np.int64)
        stamps = np.sort(pixel * n + place)
        asked = np.flatnonzero(home)
        since = times[asked] - self.cfg.window_us
        supported = np.zeros(n, dtype=bool)
        for step in self.steps:
            near = pixel[asked] + step
            at = stamps[np.maximum(np.searchsorted(stamps, near * n + asked) - 1, 0)]
            here = (at // n == near) & (at % n < asked)
            newest = np.where(here, times[at % n], self.last[near])
            supported[asked] |= newest >= since
        np.maximum.at(self.last, pixel, times)
        return rows[COLUMNS].assign(supported=supported)[home]


def background_stream(events: DataFrame, cfg: BackgroundConfig, lateness_us: int) -> DataFrame:
    """``supported`` flags; state is kept per pixel tile, so one sensor uses many tasks."""
    r, side = cfg.radius_px, cfg.tile_px
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    placed = (
        events.select(*COLUMNS)
        .withColumn("__tx", F.explode(F.sequence(floor_div(x - r, side), floor_div(x + r, side))))
        .withColumn("__ty", F.explode(F.sequence(floor_div(y - r, side), floor_div(y + r, side))))
    )
    return scan_stream(
        placed,
        ["stream_id", "__tx", "__ty"],
        ["timestamp_us", "seq"],
        "timestamp_us",
        lambda: TileActivity(cfg),
        FLAG_TYPE.format("supported"),
        lateness_us,
    )


class StaticCells:
    """Activity per cell of one sensor, with the sensor-wide sweep of idle cells.

    A cell starts over at an event if the latest sweep so far found it idle, so sweeps are found
    first and a batch is then counted cell by cell. ``seen`` has one row per active cell.
    """

    def __init__(self, cfg: StaticConfig):
        self.cfg = cfg
        self.seen = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("cell", "first", "last", "count")}).set_index("cell")
        self.swept = 0

    def _sweeps(self, times: np.ndarray) -> np.ndarray:
        """The last sweep before the batch, and those inside it."""
        found, idle = [self.swept], self.cfg.inactive_after_us
        while idle is not None:
            i = int(np.searchsorted(times, found[-1] + idle, side="right"))
            if i == len(times):
                break
            found.append(int(times[i]))
        return np.array(found)

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        cfg, n = self.cfg, len(rows)
        times = rows["timestamp_us"].to_numpy()
        cell = (rows["x"].to_numpy().astype(np.int64) // cfg.cell_size << 32) + rows["y"].to_numpy() // cfg.cell_size
        order = np.argsort(cell, kind="stable")
        c, t = cell[order], times[order]
        head = np.r_[True, c[1:] != c[:-1]]
        known = self.seen.reindex(c[head], fill_value=-1)
        group = np.cumsum(head) - 1
        held = known["count"].to_numpy()[group] > 0
        before = np.where(head, known["last"].to_numpy()[group], np.r_[0, t[:-1]])
        opens = head & ~held
        sweeps = self._sweeps(times)
        if cfg.inactive_after_us is not None:
            latest = sweeps[np.searchsorted(sweeps, t, side="right") - 1]
            opens |= latest - before > cfg.inactive_after_us
        place = np.arange(n)
        start = np.maximum.accumulate(np.where(opens | head, place, 0))
        carried = ~opens[start]
        first = np.where(carried, known["first"].to_numpy()[group], t[start])
        count = place - start + 1 + np.where(carried, known["count"].to_numpy()[group], 0)
        flags = np.zeros(n, dtype=bool)
        flags[order] = (t - first >= cfg.stable_after_us) & (count >= cfg.min_events)
        tail = np.r_[head[1:], True]
        now = pd.DataFrame({"first": first[tail], "last": t[tail], "count": count[tail]}, index=pd.Index(c[tail], name="cell"))
        seen = pd.concat([self.seen.drop(now.index, errors="ignore"), now])
        self.swept = int(sweeps[-1])
        if cfg.inactive_after_us is not None:
            seen = seen[self.swept - seen["last"] <= cfg.inactive_after_us]
        self.seen = seen
        return rows[COLUMNS].assign(is_static=flags)


def static_stream(events: DataFrame, cfg: StaticConfig, lateness_us: int) -> DataFrame:
    """``is_static`` flags. The sweep couples all cells, so state is kept per sensor."""
    return scan_stream(
        events.select(*COLUMNS),
        ["stream_id"],
        ["timestamp_us", "seq"],
        "timestamp_us",
        lambda: StaticCells(cfg),
        FLAG_TYPE.format("is_static"),
        lateness_us,
    )
