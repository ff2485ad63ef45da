"""Keep one evaluation of a large expression.

Catalyst moves filters below a projection by pasting the column's whole expression into them, and
infers more filters from the pasted copies. For lens and rotation formulas that multiplies the
plan. A column that depends on a non-deterministic value is left where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fence(value: Column) -> Column:
    """The same value, computed exactly here."""
    return F.when(F.spark_partition_id() >= 0, value)
