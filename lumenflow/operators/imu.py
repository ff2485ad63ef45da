"""Orientation from gyroscope samples and gap-checked lookups at arbitrary times."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from lumenflow.functions import geometry as g
from lumenflow.plans.hopping import floor_div
from lumenflow.plans.lineage import materialise
from lumenflow.plans.ordered import scan_ordered
from lumenflow.plans.scan import running
from lumenflow.sources.imu import GRAVITY, GYRO

#: Samples further apart than this are a gap; nothing is interpolated across it.
MAX_GAP_S = 0.05
#: Orientation is integrated in parallel over time blocks of at most this length,
BLOCK_S = 600.0
#: which end earlier where samples are dense: at the first slot behind this many rows.
BLOCK_ROWS = 1 << 14
SLOT_S = 0.02
QUATERNION = ("qw", "qx", "qy", "qz")
#: What the lookups need of the two samples around a point.
GYRO_ENDS = [f"{e}_{n}" for e in "ab" for n in GYRO]
POSE_ENDS = [*[f"{e}_{n}" for e in "ab" for n in (*QUATERNION, *GRAVITY)], "gap_count", "starts_after_gap"]


def _columns(prefix: str, names=QUATERNION) -> g.Vec:
    return tuple(F.col(prefix + n) for n in names)


def running_products(turns: np.ndarray, held: tuple) -> np.ndarray:
    """Quaternion products of ``held`` and the first 1, 2, ... rows of ``turns``.

    The product is associative: rows are cut into stretches, which are multiplied up side by side
    and then turned by the product of all stretches before.
    """
    length = int(np.ceil(np.sqrt(len(turns))))
    padded = np.tile((1.0, 0.0, 0.0, 0.0), (-(-len(turns) // length) * length, 1))
    padded[: len(turns)] = turns
    stretches = padded.reshape(-1, length, 4)
    for k in range(1, length):
        product = g.quaternion_product(stretches[:, k - 1].T, stretches[:, k].T)
        stretches[:, k] = np.stack(product, axis=-1)
    starts = np.empty((len(stretches), 1, 4))
    for start, end in zip(starts, stretches[:, -1].tolist()):
        start[0] = held
        held = g.quaternion_product(held, end)
    whole = g.quaternion_product(np.moveaxis(starts, -1, 0), np.moveaxis(stretches, -1, 0))
    return np.stack(whole, axis=-1).reshape(-1, 4)[: len(turns)]


def _accumulate(inclusive: bool):
    """Running quaternion product in order; the state is one quaternion."""

    def machine():
        held = (1.0, 0.0, 0.0, 0.0)

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal held
            out = running_products(rows[[f"d_{n}" for n in QUATERNION]].to_numpy(), held)
            before, held = held, tuple(out[-1].tolist())
            if not inclusive:
                out = np.concatenate([[before], out[:-1]])
            result = rows.copy()
            for k, name in enumerate(QUATERNION):
                result[f"o_{name}"] = out[:, k]
            return result

        return step

    return machine


def _prefix_product(df: DataFrame, keys: list[str], order: str, inclusive: bool) -> DataFrame:
    schema = T.StructType(
        [*df.schema.fields, *[T.StructField(f"o_{n}", T.DoubleType()) for n in QUATERNION]]
    )
    return scan_ordered(df, keys, [order], _accumulate(inclusive), schema)


def time_blocks(samples: DataFrame) -> DataFrame:
    """Add ``block``, which does not decrease with time and holds few rows at any sample rate.

    Rows are counted per short slot and added up over the slots of ``BLOCK_S``, a bounded number.
    """
    placed = samples.withColumns(
        {
            "__long": F.floor(F.col("time_s") / BLOCK_S).cast("long"),
            "__slot": F.floor(F.col("time_s") / SLOT_S).cast("long"),
        }
    )
    place = ["stream_id", "__long", "__slot"]
    earlier = Window.partitionBy("stream_id", "__long").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(earlier), F.lit(0))
    # Written, so that its size is known when the join is planned.
    slots = materialise(
        placed.groupBy(*place)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*place, (F.col("__long") * (1 << 24) + floor_div(before, BLOCK_ROWS)).alias("block"))
    )
    return placed.join(slots, place).select(*samples.columns, "block")


def imu_intervals(samples: DataFrame) -> DataFrame:
    """One row per pair of neighbouring samples with both ends' gyro, gravity and orientation.

    Orientation is the ordered product of per-interval turns. The product is associative, so time
    blocks are integrated in parallel and joined by one small product over the blocks.
    """
    samples = time_blocks(samples)
    state = F.struct("time_s", *GYRO, *GRAVITY)
    paired = running(samples, ["stream_id"], "time_s", F.col("block"), last={"p": state})
    dt = F.col("time_s") - F.col("p.time_s")
    angle = tuple((F.col(f"p.{a}") + F.col(a)) * dt * 0.5 for a in GYRO)
    still = (1.0, 0.0, 0.0, 0.0)
    # Without the struct, which pandas would get as one object a row.
    turned = paired.select(
        *samples.columns,
        F.coalesce((dt > MAX_GAP_S).cast("long"), F.lit(0).cast("long")).alias("gap"),
        *[
            F.coalesce(turn, F.lit(unit)).alias(f"d_{name}")
            for turn, unit, name in zip(g.quaternion_of(angle), still, QUATERNION)
        ],
    )
    # Written once: the block ends and every sample both come from it.
    local = materialise(_prefix_product(turned, ["stream_id", "block"], "time_s", inclusive=True))
    ends = local.groupBy("stream_id", "block").agg(
        *[F.max_by(f"o_{n}", "time_s").alias(f"d_{n}") for n in QUATERNION],
        F.max("time_s").alias("end_s"),
    )
    # The stream's end comes with its few blocks; a join of every sample on the stream alone would be one task.
    final = ends.groupBy("stream_id").agg(F.max("end_s").alias("duration_s"))
    lead_in = _prefix_product(ends, ["stream_id"], "block", inclusive=False).join(final, "stream_id").select(
        "stream_id", "block", "duration_s", *[F.col(f"o_{n}").alias(f"c_{n}") for n in QUATERNION]
    )
    full = local.join(lead_in, ["stream_id", "block"])
    oriented = full.select(
        "stream_id",
        "block",
        "duration_s",
        "time_s",
        *GYRO,
        *GRAVITY,
        "gap",
        *[
            q.alias(n)
            for q, n in zip(g.quaternion_product(_columns("c_"), _columns("o_")), QUATERNION)
        ],
    )
    oriented = materialise(oriented)
    # The previous sample again, now with its orientation and the gaps so far.
    every = F.struct("time_s", *GYRO, *GRAVITY, *QUATERNION, "gap")
    linked = running(
        oriented,
        ["stream_id"],
        "time_s",
        F.col("block"),
        last={"p": every},
        total={"gaps_before": F.col("gap")},
    ).where("p is not null")
    return linked.select(
        "stream_id",
        F.col("p.time_s").alias("t0"),
        F.col("time_s").alias("t1"),
        *[F.col(f"p.{n}").alias(f"a_{n}") for n in (*GYRO, *GRAVITY, *QUATERNION)],
        *[F.col(n).alias(f"b_{n}") for n in (*GYRO, *GRAVITY, *QUATERNION)],
        (F.col("gaps_before") + F.col("gap")).alias("gap_count"),
        F.col("p.gap").alias("starts_after_gap"),
        (F.col("time_s") == F.col("duration_s")).alias("is_last"),
        "duration_s",
    )


def lookup(points: DataFrame, intervals: DataFrame, at: str, keep: list[str]) -> DataFrame:
    """Inner two-sided as-of join: the interval that brackets ``at`` on the same stream.

    Usable intervals are no longer than the allowed gap, so each touches at most two time buckets.
    Inside a bucket, points and interval starts are merged in time order and the newest start is
    carried forward: one sort, no candidate pairs. Adds the blend weight ``w``; points outside the
    samples or inside a gap find nothing.
    """

    def bucket(t):
        return F.floor(t / MAX_GAP_S).cast("long")

    held = ["t0", "t1", "is_last", *keep]
    starts = (
        intervals.where(F.col("t1") - F.col("t0") <= MAX_GAP_S)
        .withColumn("__bucket", F.explode(F.sequence(bucket(F.col("t0")), bucket(F.col("t1")))))
        .select("stream_id", "__bucket", F.col("t0").alias("__at"), F.lit(0).alias("__asks"), F.struct(*held).alias("__v"))
    )
    asked = points.select(
        "stream_id",
        bucket(F.col(at)).alias("__bucket"),
        F.col(at).alias("__at"),
        F.lit(1).alias("__asks"),
        F.struct(*points.columns).alias("__p"),
    )
    order = (
        Window.partitionBy("stream_id", "__bucket")
        .orderBy("__at", "__asks")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        asked.unionByName(starts, allowMissingColumns=True)
        .withColumn("__v", F.last("__v", ignorenulls=True).over(order))
        .where(
            (F.col("__asks") == 1)
            & ((F.col("__at") < F.col("__v.t1")) | (F.col("__v.is_last") & (F.col("__at") == F.col("__v.t1"))))
        )
    )
    return found.select(
        *[F.col(f"__p.{c}").alias(c) for c in points.columns],
        *[F.col(f"__v.{c}").alias(c) for c in ("t0", *keep)],
        ((F.col("__at") - F.col("__v.t0")) / (F.col("__v.t1") - F.col("__v.t0"))).alias("w"),
    )


def gyro_at(points: DataFrame, intervals: DataFrame, at: str = "time_s") -> DataFrame:
    """Linear gyro at each point; points without coverage are dropped."""
    return mixed_gyro(lookup(points, intervals, at, GYRO_ENDS), points.columns)


def mixed_gyro(found: DataFrame, columns: list[str]) -> DataFrame:
    """Gyro between the two samples that ``lookup`` found."""
    mixed = g.lerp(_columns("a_", GYRO), _columns("b_", GYRO), F.col("w"))
    return found.select(*columns, *[v.alias(n) for v, n in zip(mixed, GYRO)])


def gravity_vector(w: Column) -> Column:
    """Unit vector toward the ground as a struct, null without gravity columns."""
    mixed = g.lerp(_columns("a_", GRAVITY), _columns("b_", GRAVITY), w)
    size = g.norm(mixed)
    unit = [F.when(size > 1e-6, v / size).alias(n) for v, n in zip(mixed, GRAVITY)]
    return F.when(size > 1e-6, F.struct(*unit))


def orientation_at(points: DataFrame, intervals: DataFrame, at: str = "time_s") -> DataFrame:
    """Add orientation ``qw..qz``, ``gap_count``, ``gap_floor`` and ``down`` to covered points.

    Two covered times are free of gaps in between when the earlier one's ``gap_floor`` equals the
    later one's ``gap_count``; a time exactly on the first sample after a gap touches that gap.
    """
    return mixed_orientation(lookup(points, intervals, at, POSE_ENDS), at, points.columns)


def mixed_orientation(found: DataFrame, at: str, columns: list[str]) -> DataFrame:
    """Orientation and gravity between the two samples that ``lookup`` found."""
    blend = g.quaternion_blend(_columns("a_"), _columns("b_"), F.col("w"))
    touches = F.when(F.col(at) == F.col("t0"), F.col("starts_after_gap")).otherwise(F.lit(0))
    return found.select(
        *columns,
        *[q.alias(n) for q, n in zip(blend, QUATERNION)],
        "gap_count",
        (F.col("gap_count") - touches).alias("gap_floor"),
        gravity_vector(F.col("w")).alias("down"),
    )


def prepared_imu(samples: DataFrame) -> DataFrame:
    """Intervals written once, because every later stage looks times up in them."""
    return materialise(imu_intervals(materialise(samples)))
