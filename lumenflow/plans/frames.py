"""Bounded frames of rows or time over long sequences.

A frame of the last n rows needs a total order per key, which would put a whole stream into one
task. Rows are numbered by a blocked scan and cut into chunks that repeat the last n - 1 rows of
the chunk before, so every frame is complete inside its own chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenflow.plans.hopping import floor_div
from lumenflow.plans.ordered import spread
from lumenflow.plans.scan import running

CHUNK_ROWS = 4096


def last_rows(
    df: DataFrame, keys: list[str], order: str, block: Column, count: int, held: dict[str, Column]
) -> DataFrame:
    """Add the ``held`` expressions, collected in order over the last ``count`` rows of each key.

    ``order`` is unique per key and ``block`` a non-decreasing function of it.
    """
    one = F.lit(1).cast("long")
    numbered = running(df, keys, order, block, total={"__n": one})
    home = floor_div(F.col("__n"), CHUNK_ROWS)
    chunked = numbered.withColumn(
        "__chunk", F.explode(F.sequence(home, floor_div(F.col("__n") + count - 1, CHUNK_ROWS)))
    )
    frame = (
        Window.partitionBy(*keys, "__chunk").orderBy("__n").rowsBetween(1 - count, Window.currentRow)
    )
    lists = [F.collect_list(value).over(frame).alias(name) for name, value in held.items()]
    return (
        spread(chunked, [*keys, "__chunk"])
        .select(*df.columns, "__n", "__chunk", *lists)
        .where(F.col("__chunk") == home)
        .drop("__n", "__chunk")
    )


#: A chunk of time is this many frames long, so few rows lie in two chunks.
CHUNK_SPANS = 64


def recent_rows(df: DataFrame, keys: list[str], at: str, span: int, held: dict[str, Column]) -> DataFrame:
    """Add the ``held`` expressions, collected over the key's rows at ``[at - span, at]``, nulls left out.

    ``at`` is a whole number. Time is cut into chunks that repeat the last ``span`` of the chunk before,
    so a long key is many tasks. Rows at the same time are in each other's frame; the order inside a
    list is that of time, open among equal times. Rows without a time are left out.
    """
    length = max(span, 1) * CHUNK_SPANS
    home = floor_div(F.col(at), length)
    chunked = df.withColumn("__chunk", F.explode(F.sequence(home, floor_div(F.col(at) + span, length))))
    frame = Window.partitionBy(*keys, "__chunk").orderBy(at).rangeBetween(-span, Window.currentRow)
    lists = [F.collect_list(value).over(frame).alias(name) for name, value in held.items()]
    return (
        spread(chunked, [*keys, "__chunk"])
        .select(*df.columns, "__chunk", *lists)
        .where(F.col("__chunk") == home)
        .drop("__chunk")
    )
