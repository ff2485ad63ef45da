"""Streaming tracker over candidates, and live time unwrapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenflow.config import CameraModel, InvalidConfig, MotionConfig, TrackerConfig
from lumenflow.functions import evt
from lumenflow.operators.tracker import TRACK_TYPE, TrackMachine
from lumenflow.schema import EVENT_COLUMNS
from lumenflow.streaming.ordered import scan_stream

#: A live view that is further behind than this starts over at the newest complete step.
LIVE_LAG_US = 150_000


class LiveTracker:
    """Tracker of one live sensor; optionally skips ahead when its input has piled up.

    An update that is further than ``skip_lag_us`` behind the newest input received, waiting rows
    included, is left out together with all before the newest update; tracking then starts over.
    """

    def __init__(self, camera, cfg: MotionConfig, diameter_m: float, skip_lag_us: int | None):
        self.args = (camera, cfg, diameter_m)
        self.machine = TrackMachine(*self.args)
        self.skip_lag_us = skip_lag_us
        self.newest_us = self.resume_us = None
        self.skipped = 0

    def newest(self, time_us: int) -> None:
        self.newest_us = max(time_us, self.newest_us or time_us)

    def _skip(self, ends: np.ndarray) -> None:
        behind = self.resume_us is None or ends[0] >= self.resume_us
        if behind and self.newest_us - ends[0] > self.skip_lag_us:
            self.resume_us = self.newest_us
            born = self.machine.tracks
            self.machine = TrackMachine(*self.args)
            self.machine.memory = self.machine.memory._replace(born=born)

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        if self.skip_lag_us is not None:
            self._skip(rows["end_us"].to_numpy())
            if self.resume_us is not None:
                left_out = rows["end_us"] < self.resume_us
                self.skipped += rows.loc[left_out, "window_id"].nunique()
                rows = rows[~left_out]
        if rows.empty:
            return rows
        return self.machine(rows.assign(episode=0)).assign(skipped=self.skipped)


def track_stream(
    updates: DataFrame,
    camera: CameraModel,
    cfg: MotionConfig,
    tracker: TrackerConfig,
    lateness_us: int,
    skip_lag_us: int | None = None,
) -> DataFrame:
    """Tracks from a stream of updates: one row per candidate, or one row of nulls without any.

    Columns are those of the batch tracker's input (window, pose, gravity, candidate) plus
    ``end_us``. Nothing is skipped unless ``skip_lag_us`` asks for it; ``skipped`` counts the updates
    that the stream has left out so far. Rows always wait ``lateness_us``, so the lag must be longer.
    """
    if skip_lag_us is not None and skip_lag_us <= lateness_us:
        raise InvalidConfig("skip_lag_us", "must be longer than the lateness")
    return scan_stream(
        updates,
        ["stream_id"],
        ["window_id", "rank"],
        "end_us",
        lambda: LiveTracker(camera, cfg, tracker.ball_diameter_m, skip_lag_us),
        f"{TRACK_TYPE}, skipped long",
        lateness_us,
    ).drop("episode")


def unwrap_stream(records: DataFrame) -> DataFrame:
    """Events with continuing time from a recording source read with ``timeRows`` and ``live``.

    The source delivers a stream's records in stream order from batch to batch, so the state is
    three numbers per stream.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, wraps, peak = state.get if state.exists else (-1, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        is_time = (rows["record_type"] == evt.TIME).to_numpy()
        high = rows["timestamp_us"].to_numpy()[is_time] // 4096
        previous = np.r_[before if before >= 0 else (high[0] if len(high) else 0), high[:-1]]
        step = np.zeros(len(rows), dtype=np.int64)
        step[is_time] = previous[: len(high)] - high > 2048
        turns = wraps + np.cumsum(step)
        events = rows[~is_time]
        at = np.maximum.accumulate(
            np.r_[peak, events["timestamp_us"].to_numpy() + turns[~is_time] * evt.WRAP_US]
        )
        state.update((int(high[-1]) if len(high) else before, int(turns[-1]), int(at[-1])))
        if len(events):
            yield events.assign(timestamp_us=at[1:])[EVENT_COLUMNS]

    kept = records.where(F.col("record_type").isin(evt.TIME, evt.EVENT))
    return kept.groupBy("stream_id").applyInPandasWithState(
        run,
        "stream_id string, seq long, timestamp_us long, x int, y int, polarity boolean",
        "high long, wraps long, peak long",
        "append",
        GroupStateTimeout.NoTimeout,
    )
