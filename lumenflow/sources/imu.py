"""Inertial samples: CSV reader and synthetic still-camera samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenflow.config import InvalidConfig

GYRO = ("gx", "gy", "gz")
GRAVITY = ("gravity_x", "gravity_y", "gravity_z")
#: Shares that a stream's samples are dealt into where they meet the stream's start.
SHARES = 64


def read_imu_csv(spark: SparkSession, path: str, stream_id: str | None = None) -> DataFrame:
    """Columns are found by name in any order; every value must be a finite number.

    One file is one stream, named after the file unless ``stream_id`` is given. The result has
    ``stream_id, time_s, gx, gy, gz, gravity_x, gravity_y, gravity_z`` with time from zero.
    """
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*[name.lstrip("﻿").strip() for name in raw.columns])
    if not {"timestamp", *GYRO} <= set(raw.columns):
        raise InvalidConfig("imu", "needs timestamp,gx,gy,gz columns (seconds and rad/s)")
    has_gravity = set(GRAVITY) <= set(raw.columns)
    wanted = ["timestamp", *GYRO, *(GRAVITY if has_gravity else ())]
    name = F.lit(stream_id) if stream_id else F.element_at(F.split(F.input_file_name(), "/"), -1)

    def number(column: str):
        value = F.col(column).try_cast("double")
        good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
        return F.when(good, value).otherwise(F.raise_error(F.lit("invalid IMU sample")).cast("double"))

    samples = raw.select(
        name.alias("stream_id"),
        *[number(c).alias(c) for c in wanted],
        F.monotonically_increasing_id().alias("__row"),
    )
    return rebase(samples.withColumnRenamed("timestamp", "time_s"), has_gravity)


def rebase(samples: DataFrame, has_gravity: bool) -> DataFrame:
    """Keep the first sample of equal times and count time from the first sample.

    ``__row`` orders samples that share a time. A stream with fewer than two distinct times is an
    error, raised when the table is evaluated.
    """
    columns = [*GYRO, *(GRAVITY if has_gravity else ())]
    single = samples.groupBy("stream_id", "time_s").agg(
        F.min_by(F.struct(*columns), "__row").alias("s")
    )
    spans = single.groupBy("stream_id").agg(
        F.min("time_s").alias("first_s"), F.count(F.lit(1)).alias("samples")
    )
    start = F.when(F.col("samples") >= 2, F.col("first_s")).otherwise(
        F.raise_error(F.lit("at least two IMU samples with different times are required")).cast("double")
    )
    gravity = [F.col(f"s.{c}") if has_gravity else F.lit(None).cast("double") for c in GRAVITY]
    dealt = single.withColumn("__share", F.pmod(F.hash("time_s"), F.lit(SHARES)))
    each = spans.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return dealt.join(each, ["stream_id", "__share"]).select(
        "stream_id",
        (F.col("time_s") - start).alias("time_s"),
        *[F.col(f"s.{c}") for c in GYRO],
        *[g.alias(c) for g, c in zip(gravity, GRAVITY)],
    )


def _stem(name: str):
    return F.regexp_replace(name, r"\.[^.]*$", "")


def imu_of_recordings(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Samples of ``read_imu_csv`` under the streams of ``spans`` whose name, without ending, is the same.

    A stream without samples is an error, so no recording is left out by the joins that follow.
    """
    streams = spans.select("stream_id", _stem("stream_id").alias("stem"))
    files = samples.select("stream_id").distinct().select(_stem("stream_id").alias("stem"))
    missing = streams.join(files, "stem", "left_anti").agg(F.min("stream_id"), F.count("stream_id")).first()
    if missing[1]:
        raise InvalidConfig("imu", f"no CSV named like {missing[0]} ({missing[1]} recordings without samples)")
    return samples.withColumn("stem", _stem("stream_id")).drop("stream_id").join(streams, "stem").drop("stem")


def still_imu(spans: DataFrame, step_s: float = 0.02) -> DataFrame:
    """Zero rotation and gravity along the image's vertical over each stream's time (stream_id, first_us, last_us)."""
    duration_s = (F.col("last_us") - F.col("first_us")) * 1e-6
    ids = F.sequence(F.lit(0).cast("long"), F.floor(duration_s / step_s) + 1)
    zero = F.lit(0.0)
    return spans.select("stream_id", F.explode(ids).alias("id")).select(
        "stream_id",
        (F.col("id") * step_s).alias("time_s"),
        *[zero.alias(c) for c in GYRO],
        *[F.lit(g).alias(c) for g, c in zip((0.0, 1.0, 0.0), GRAVITY)],
    )
