"""Prefix scans that split a hot key.

A window ``partitionBy(key)`` puts every row of a key into one task. ``running`` cuts each key
into blocks of the order column, scans blocks in parallel and adds what earlier blocks carry in.
The carry table has one row per non-empty (key, block) and comes from a map-side combined
aggregate, so a key that holds a third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T


def newest(rows: DataFrame, name: str, at: Column) -> Column:
    """Aggregate: the non-null value of a column with the largest ``at``.

    The fields of a struct are taken one by one: their buffers have a fixed size, so rows are
    aggregated in a hash table, while a buffer that holds a struct makes Spark sort all rows first.
    """
    kind = rows.schema[name].dataType
    here = F.when(F.col(name).isNotNull(), at)
    if not isinstance(kind, T.StructType):
        return F.max_by(name, here)
    fields = [F.max_by(F.col(name)[f], here).alias(f) for f in kind.names]
    return F.when(F.max(here).isNotNull(), F.struct(*fields))


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    block: Column,
    last: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    peak: dict[str, Column] | None = None,
    include_current: bool = False,
) -> DataFrame:
    """Add running "last non-null value", sum and maximum columns per key.

    ``order`` must be unique per key and ``block`` a non-decreasing function of it. With
    ``include_current`` the current row counts, otherwise only rows before it.
    """
    last, total, peak = last or {}, total or {}, peak or {}
    at = F.col(order)
    rows = df.withColumn("__block", block)
    for name, value in {**last, **total, **peak}.items():
        rows = rows.withColumn(f"__in_{name}", value)
    # The first sort key decides most comparisons; the leading key is often one value for all rows.
    group = [*reversed(keys[1:]), "__block", *keys[:1]]

    ends = [newest(rows, f"__in_{n}", at).alias(n) for n in last]
    sums = [F.sum(f"__in_{n}").alias(n) for n in total]
    tops = [F.max(f"__in_{n}").alias(n) for n in peak]
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*group)
        .agg(*ends, *sums, *tops)
        .select(
            *group,
            *[F.last(n, ignorenulls=True).over(before).alias(f"__carry_{n}") for n in last],
            *[F.sum(n).over(before).alias(f"__carry_{n}") for n in total],
            *[F.max(n).over(before).alias(f"__carry_{n}") for n in peak],
        )
    )

    inside = (
        Window.partitionBy(*group)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    joined = rows.join(carry, group, "left")
    return joined.select(
        *df.columns,
        *[
            F.coalesce(F.last(f"__in_{n}", ignorenulls=True).over(inside), f"__carry_{n}").alias(n)
            for n in last
        ],
        *[
            (
                F.coalesce(F.sum(f"__in_{n}").over(inside), F.lit(0))
                + F.coalesce(f"__carry_{n}", F.lit(0))
            ).alias(n)
            for n in total
        ],
        *[F.greatest(F.max(f"__in_{n}").over(inside), f"__carry_{n}").alias(n) for n in peak],
    )
