"""Ordered state for streams: hold rows until the watermark has passed, then process in order.

A micro-batch brings a key's rows in any order. Rows wait in the key's state until no earlier row
can arrive, so the machine sees the same sequence as the batch operators do. The state holds one
lateness interval of rows and the machine itself.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Machine = Callable[[pd.DataFrame], pd.DataFrame]


def scan_stream(
    stream: DataFrame,
    keys: list[str],
    order: list[str],
    time_us: str,
    machine: Callable[[], Machine],
    schema: str,
    lateness_us: int,
) -> DataFrame:
    """Run a picklable ``machine()`` per key over rows in ``order``, one lateness behind the newest.

    Rows later than ``lateness_us`` are dropped by the watermark. A machine with a method ``newest``
    is told the newest time its key has received, waiting rows included, before each step.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, step = pickle.loads(state.get[0]) if state.exists else ([], machine())
        if not state.hasTimedOut:
            held = [*held, *(b.drop(columns="__time") for b in batches)]
        mark = state.getCurrentWatermarkMs() * 1000
        rows = pd.concat(held, ignore_index=True) if held else None
        if rows is not None and len(rows) and hasattr(step, "newest"):
            step.newest(int(rows[time_us].max()))
        if rows is not None and len(rows):
            ready = (rows[time_us] < mark).to_numpy()
            due, rows = rows[ready], rows[~ready]
            if len(due):
                out = step(due.sort_values(order, kind="stable"))
                if len(out):
                    yield out
        kept = [rows] if rows is not None and len(rows) else []
        state.update((pickle.dumps((kept, step)),))
        if kept:
            # The next whole millisecond after the oldest waiting row.
            due_ms = max(int(rows[time_us].min()) // 1000 + 1, state.getCurrentWatermarkMs() + 1)
            state.setTimeoutTimestamp(due_ms)

    marked = stream.withColumn("__time", F.timestamp_micros(time_us)).withWatermark(
        "__time", f"{lateness_us} microseconds"
    )
    return marked.groupBy(*keys).applyInPandasWithState(
        run, schema, "blob binary", "append", GroupStateTimeout.EventTimeTimeout
    )
