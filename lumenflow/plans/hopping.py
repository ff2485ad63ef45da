"""Hopping windows as explode + equi key, never as a theta join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def floor_div(a: Column, b: int) -> Column:
    """Integer floor of ``a / b`` for any sign of ``a`` (SQL ``div`` truncates)."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def ceil_div(a: Column, b: int) -> Column:
    return floor_div(a + F.lit(b - 1), b)


def hop_range(
    since_origin: Column, window_us: int, step_us: int, first: Column | int = 0, last: Column | int | None = None
) -> tuple[Column, Column]:
    """First and last window ``[k*step - window, k*step]`` that covers a time, both ends closed."""
    low = F.greatest(ceil_div(since_origin, step_us), F.lit(first).cast("long"))
    high = floor_div(since_origin + F.lit(window_us), step_us)
    if last is not None:
        high = F.least(high, F.lit(last).cast("long"))
    return low, high


def explode_hops(
    df: DataFrame,
    since_origin: Column,
    window_us: int,
    step_us: int,
    first: Column | int = 0,
    last: Column | int | None = None,
    name: str = "window_id",
) -> DataFrame:
    """One row per event and covering window ``[k*step - window, k*step]``, both ends closed."""
    low, high = hop_range(since_origin, window_us, step_us, first, last)
    return (
        df.withColumn("__low", low)
        .withColumn("__high", high)
        .where("__low <= __high")
        .withColumn(name, F.explode(F.sequence("__low", "__high")))
        .drop("__low", "__high")
    )


#: A slice of windows is this many window lengths long, so few panes lie in two slices.
SLICE_WINDOWS = 16
MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def hop_aggregate(
    df: DataFrame,
    keys: list[str],
    since_origin: Column,
    window_us: int,
    step_us: int,
    measures: dict[str, tuple[Column, str]],
    first: Column | int = 0,
    last: Column | int | None = None,
    name: str = "window_id",
) -> DataFrame:
    """Aggregates per key and hopping window, from panes: events that lie in the same windows.

    ``measures`` gives each result's aggregate and how panes of it merge (``sum``, ``min``, ``max``).
    Events are aggregated once per pane, before the first shuffle as far as they meet there. Panes
    are shuffled by key and slice of windows, and become windows only behind that shuffle, so what
    is shuffled does not grow with window / step.
    """
    low, high = hop_range(since_origin, window_us, step_us, first, last)
    panes = (
        df.withColumn("__low", low)
        .withColumn("__high", high)
        .where("__low <= __high")
        .groupBy(*keys, "__low", "__high")
        .agg(*[made.alias(n) for n, (made, _) in measures.items()])
    )
    length = SLICE_WINDOWS * (window_us // step_us + 1)
    slices = F.sequence(floor_div(F.col("__low"), length), floor_div(F.col("__high"), length))
    placed = panes.withColumn("__slice", F.explode(slices)).repartition(*keys, "__slice")
    inside = F.sequence(
        F.greatest("__low", F.col("__slice") * length),
        F.least(F.col("__high"), F.col("__slice") * length + (length - 1)),
    )
    return (
        placed.withColumn(name, F.explode(inside))
        .groupBy(*keys, "__slice", name)
        .agg(*[MERGE[how](n).alias(n) for n, (_, how) in measures.items()])
        .drop("__slice")
    )
