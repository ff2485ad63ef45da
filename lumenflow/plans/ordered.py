"""Order-dependent state machines that never hold a group in memory.

Rows are hash-partitioned by ``keys`` and sorted inside the partition, then streamed through
``mapInPandas``. Each Arrow batch is cut at key changes; a machine keeps its own small state
between batches. The input should already be reduced to a few rows per update.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition by ``keys`` with the session's number of partitions.

    The rows before a Python step are few bytes but costly, and adaptive execution, which merges
    partitions by size, would put them into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """What is executed inside joins two sides that ``spread`` dealt by some of the join's keys as they lie.

    Spark's default deals both sides anew by all keys of the join.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scan_ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    machine: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: T.StructType | str,
) -> DataFrame:
    """``machine()`` builds a fresh state per key; it maps ordered chunks to output rows.

    Rows that share the first ``order`` column always arrive in the same chunk.
    """
    tick = order[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current, held = None, None, None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
                held = None
            if batch.empty:
                continue
            columns = [batch[k].to_numpy() for k in keys]
            changed = np.zeros(len(batch), dtype=bool)
            for column in columns:
                changed[1:] |= column[1:] != column[:-1]
            starts = [0, *np.flatnonzero(changed).tolist()]
            ends = [*starts[1:], len(batch)]
            for n, (a, b) in enumerate(zip(starts, ends)):
                chunk = batch.iloc[a:b]
                if n == len(starts) - 1:
                    # The batch may end inside an update: keep its rows for the next batch.
                    open_tick = (chunk[tick] == chunk[tick].iloc[-1]).to_numpy()
                    held = chunk[open_tick]
                    chunk = chunk[~open_tick]
                key = tuple(column[a] for column in columns)
                if key != current:
                    state, current = machine(), key
                if len(chunk):
                    out = state(chunk)
                    if len(out):
                        yield out
        if held is not None and len(held):
            key = tuple(held[k].iloc[0] for k in keys)
            if key != current:
                state = machine()
            out = state(held)
            if len(out):
                yield out

    ordered = spread(df, keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, schema)
