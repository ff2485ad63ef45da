"""Keep a bounded number of rows, spread over all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def evenly(rank: Column, count: Column, most: int) -> Column:
    """True for ``least(count, most)`` of the ranks 0..count-1, at equal distances from first to last."""
    return thinned_rank(rank + 1, count, most) > thinned_rank(rank, count, most)


def thinned_rank(rank: Column, count: Column, most: int) -> Column:
    """Rank among the rows that ``evenly`` keeps."""
    place = F.floor(rank.cast("long") * F.lit(most) / count).cast("long")
    return F.when(count > most, place).otherwise(rank.cast("long"))
