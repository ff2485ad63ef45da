"""Broadcast only behind a check of the side's real size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``limit`` rows, else leave the shuffle join.

    The probe stops after ``limit + 1`` rows. Call it on tables that are cheap to read.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
