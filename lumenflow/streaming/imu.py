"""Inertial samples that arrive as a stream: orientation in order, and lookups from a stream of points.

Samples have ``stream_id, seq, time_s`` with the columns of ``lumenflow.sources.imu``; they may come in
any order within the lateness. A sample at the time of an earlier one (by ``seq``) is ignored. Both
lookups find what the batch lookups find, except that a stream never knows its last sample: a point
exactly at a sample that nothing follows finds nothing, as before a gap.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenflow.functions import geometry as g
from lumenflow.operators.imu import MAX_GAP_S, QUATERNION, mixed_gyro, mixed_orientation
from lumenflow.sources.imu import GRAVITY, GYRO
from lumenflow.streaming.ordered import scan_stream

ORIENTED = ("time_s", *GYRO, *GRAVITY, *QUATERNION)
ORIENTED_TYPE = (
    "stream_id string, seq long, " + ", ".join(f"{n} double" for n in ORIENTED) + ", gap_count long, after_gap long"
)
#: Longer than the allowed gap by enough that rounding never moves a neighbour two buckets away.
BUCKET_S = 1.2 * MAX_GAP_S


def _turn(angle: np.ndarray) -> tuple[float, ...]:
    size = math.sqrt(angle @ angle)
    factor = 0.5 if size < 1e-12 else math.sin(size / 2) / size
    return (math.cos(size / 2), *(factor * angle).tolist())


class Integrator:
    """Orientation of one stream of samples so far: a time, a rate, a quaternion and the gaps met."""

    def __init__(self):
        self.time_s, self.rate = None, None
        self.at = (1.0, 0.0, 0.0, 0.0)
        self.gaps = 0

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        times, rates = rows["time_s"].to_numpy(), rows[list(GYRO)].to_numpy(dtype=float)
        fresh = times > np.maximum.accumulate(np.r_[-np.inf if self.time_s is None else self.time_s, times[:-1]])
        rows, times, rates = rows[fresh], times[fresh], rates[fresh]
        turns, after = np.empty((len(rows), 4)), np.zeros(len(rows), dtype=np.int64)
        for i, (time_s, rate) in enumerate(zip(times.tolist(), rates)):
            if self.time_s is not None:
                dt = time_s - self.time_s
                self.at = g.quaternion_product(self.at, _turn((self.rate + rate) * dt * 0.5))
                after[i] = dt > MAX_GAP_S
            self.time_s, self.rate, turns[i] = time_s, rate, self.at
        counts = self.gaps + np.cumsum(after)
        self.gaps += int(after.sum())
        quaternions = {name: turns[:, k] for k, name in enumerate(QUATERNION)}
        kept = rows[["stream_id", "seq", "time_s", *GYRO, *GRAVITY]]
        return kept.assign(**quaternions, gap_count=counts, after_gap=after)


def orient_stream(samples: DataFrame, lateness_us: int) -> DataFrame:
    """Samples in order of time with the orientation since the first and the gaps up to each.

    A stream's samples are one state of a few numbers. Write the result to an append-only table;
    ``orientation_stream`` reads that table as a stream.
    """
    timed = samples.withColumn("at_us", F.floor(F.col("time_s") * 1e6).cast("long"))
    return scan_stream(timed, ["stream_id"], ["time_s", "seq"], "at_us", Integrator, ORIENTED_TYPE, lateness_us)


def _filler(kind: T.DataType) -> Column:
    """A value for the other side's rows, so that whole numbers stay whole in pandas."""
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return {"boolean": F.lit(False), "string": F.lit("")}.get(kind.typeName(), F.lit(None).cast(kind))


def bracket_stream(points: DataFrame, samples: DataFrame, held: list[str], lateness_us: int, at: str = "time_s") -> DataFrame:
    """Points with the two samples around them: ``t0``, ``a_*`` and ``b_*`` of ``held`` and the weight ``w``.

    Points wait in the state of their stream and 60 ms of time, where each sample goes three times. The
    state is asked once, when both streams' watermarks have passed the last sample that could matter,
    and is then removed. If one stream stands still, the other waits. Points outside the samples or
    inside a gap find nothing; so does a later row than the lateness. Columns of points must not be null.
    """
    fields = points.schema.fields
    asked_columns = [f"p_{f.name}" for f in fields]
    held_columns = [f"s_{n}" for n in held]

    def timed(df: DataFrame, time_s: Column) -> DataFrame:
        moment = F.timestamp_micros(F.floor(time_s * 1e6).cast("long"))
        return df.withColumn("__time", moment).withWatermark("__time", f"{lateness_us} microseconds")

    bucket = F.floor(F.col("__at") / BUCKET_S).cast("long")
    asked = (
        timed(points.select("*", F.col(at).alias("__at")), F.col("__at"))
        .select(
            F.col("stream_id").alias("__stream"), bucket.alias("__bucket"), "__time", F.lit(True).alias("__asks"), "__at",
            F.lit(0).cast("long").alias("__seq"),
            *[F.col(f.name).alias(p) for f, p in zip(fields, asked_columns)],
            *[F.lit(0.0).alias(s) for s in held_columns],
        )
    )
    given = (
        timed(samples.withColumn("__at", F.col("time_s")), F.col("__at"))
        .withColumn("__bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
        .select(
            F.col("stream_id").alias("__stream"), "__bucket", "__time", F.lit(False).alias("__asks"), "__at",
            F.col("seq").cast("long").alias("__seq"),
            *[_filler(f.dataType).alias(p) for f, p in zip(fields, asked_columns)],
            *[F.col(n).cast("double").alias(s) for n, s in zip(held, held_columns)],
        )
    )
    ends = [f"{e}_{n}" for e in "ab" for n in held]
    schema = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in ("t0", *ends, "w")]])

    def bracketed(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["__asks"].to_numpy(dtype=bool)
        known = rows[~asks].sort_values(["__at", "__seq"], kind="stable").drop_duplicates("__at")
        times, values = known["__at"].to_numpy(), known[held_columns].to_numpy(dtype=float)
        open_rows = rows[asks]
        moment = open_rows["__at"].to_numpy()
        i = np.searchsorted(times, moment, side="right") - 1
        good = (i >= 0) & (i + 1 < len(times))
        good[good] &= times[i[good] + 1] - times[i[good]] <= MAX_GAP_S
        i, moment = i[good], moment[good]
        out = open_rows[good][asked_columns].set_axis([f.name for f in fields], axis=1).reset_index(drop=True)
        found = {"t0": times[i]}
        found |= {f"a_{n}": values[i, k] for k, n in enumerate(held)}
        found |= {f"b_{n}": values[i + 1, k] for k, n in enumerate(held)}
        found["w"] = (moment - times[i]) / (times[i + 1] - times[i])
        return pd.concat([out, pd.DataFrame(found)], axis=1)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = pickle.loads(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            out = bracketed(pd.concat(waiting, ignore_index=True))
            if len(out):
                yield out
            return
        waiting.extend(b.drop(columns="__time") for b in batches)
        state.update((pickle.dumps(waiting),))
        due_ms = math.ceil((key[1] + 2) * BUCKET_S * 1000) + 1
        state.setTimeoutTimestamp(max(due_ms, state.getCurrentWatermarkMs() + 1))

    return (
        asked.union(given)
        .groupBy("__stream", "__bucket")
        .applyInPandasWithState(run, schema, "rows binary", "append", GroupStateTimeout.EventTimeTimeout)
    )


def gyro_stream(points: DataFrame, samples: DataFrame, lateness_us: int, at: str = "time_s") -> DataFrame:
    """``operators.imu.gyro_at`` of two streams."""
    return mixed_gyro(bracket_stream(points, samples, list(GYRO), lateness_us, at), points.columns)


def orientation_stream(points: DataFrame, oriented: DataFrame, lateness_us: int, at: str = "time_s") -> DataFrame:
    """``operators.imu.orientation_at`` of two streams; ``oriented`` is what ``orient_stream`` wrote."""
    held = [*QUATERNION, *GRAVITY, "gap_count", "after_gap"]
    found = bracket_stream(points, oriented, held, lateness_us, at).withColumns(
        {n: F.col(f"a_{old}").cast("long") for n, old in (("gap_count", "gap_count"), ("starts_after_gap", "after_gap"))}
    )
    return mixed_orientation(found, at, points.columns)
