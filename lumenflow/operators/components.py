"""8-connected components of occupied cells, per window.

Cells are aggregates, so a window has at most as many rows as the sensor has cells, however many
events it holds. Labelling runs on square tiles of bounded size. When a window's grid fits one
tile (the usual case) that is all. Larger grids are stitched: border contacts between tile
components form a small graph whose minimum labels spread by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from lumenflow.functions.label import connected
from lumenflow.plans.hopping import floor_div
from lumenflow.plans.lineage import materialise

#: Label of a cell: fixed stride, so labels order like (cx, cy).
LABEL_STRIDE = 1 << 16
#: Cells in one tile; bounds the rows that one labelling step holds.
MAX_TILE_CELLS = 1 << 20


def cell_label(cx, cy):
    return cx.cast("long") * LABEL_STRIDE + cy


def connected_cells(
    cells: DataFrame, keys: list[str], grid: tuple[int, int] | None = None, tile: int | None = None
) -> DataFrame:
    """Add ``label``: the smallest ``cx * 65536 + cy`` of the cell's component.

    ``cells`` has unique (keys, cx, cy) rows. ``grid`` is the number of columns and rows when the
    sensor size is known; without it, or when it exceeds one tile, tiles are stitched.
    """
    side = tile or int(MAX_TILE_CELLS**0.5)
    whole = tile is None and grid is not None and grid[0] * grid[1] <= MAX_TILE_CELLS
    if whole:
        return _label_tiles(cells, keys).withColumnRenamed("__local", "label")
    tiled = cells.withColumn("__tx", floor_div(F.col("cx").cast("long"), side)).withColumn(
        "__ty", floor_div(F.col("cy").cast("long"), side)
    )
    local = _label_tiles(tiled, [*keys, "__tx", "__ty"])
    return _stitch(local, keys, side).drop("__tx", "__ty", "__local")


def _label_tiles(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``__local``: minimum label inside each (keys) group, many groups per Arrow batch."""
    schema = T.StructType([*cells.schema.fields, T.StructField("__local", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            starts = _starts(table, keys)
            cut = int(starts[-1])
            if cut:
                yield from _labelled(table.slice(0, cut), starts[:-1])
                held = table.slice(cut).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from _labelled(table, _starts(table, keys))

    placed = cells.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(run, schema)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of every run of equal keys."""
    changed = np.zeros(table.num_rows, dtype=bool)
    changed[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def _labelled(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    group = np.zeros(table.num_rows, dtype=np.int64)
    group[starts[1:]] = 1
    cx, cy = table.column("cx").to_numpy(), table.column("cy").to_numpy()
    first = connected(np.cumsum(group), cx, cy)
    label = cx[first].astype(np.int64) * LABEL_STRIDE + cy[first]
    yield from table.append_column("__local", pa.array(label)).to_batches()


def _stitch(local: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Merge tile components that touch across a border into one label."""
    local = materialise(local)
    x, y = F.pmod("cx", F.lit(side)), F.pmod("cy", F.lit(side))
    border = local.where((x == 0) | (x == side - 1) | (y == 0) | (y == side - 1))
    offsets = F.array(
        *[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    )
    reach = (
        border.select(*keys, "cx", "cy", "__tx", "__ty", "__local", F.explode(offsets).alias("o"))
        .select(
            *keys,
            (F.col("cx") + F.col("o.dx")).alias("cx"),
            (F.col("cy") + F.col("o.dy")).alias("cy"),
            F.col("__tx").alias("from_tx"),
            F.col("__ty").alias("from_ty"),
            F.col("__local").alias("a"),
        )
        .where(
            (floor_div(F.col("cx").cast("long"), side) != F.col("from_tx"))
            | (floor_div(F.col("cy").cast("long"), side) != F.col("from_ty"))
        )
    )
    # Each contact is seen from both sides, so the edge set is symmetric.
    edges = materialise(
        reach.join(border.select(*keys, "cx", "cy", F.col("__local").alias("b")), [*keys, "cx", "cy"])
        .select(*keys, "a", "b")
        .distinct()
    )
    best = edges.select(*keys, F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while True:
        # One step to the neighbours, then jump to the label's own label.
        spread = edges.join(best.withColumnRenamed("node", "b"), [*keys, "b"]).select(
            *keys, F.col("a").alias("node"), "label"
        )
        stepped = best.union(spread).groupBy(*keys, "node").agg(F.min("label").alias("label"))
        own = stepped.select(*keys, F.col("node").alias("label"), F.col("label").alias("own"))
        jumped = stepped.join(own, [*keys, "label"], "left").select(
            *keys, "node", F.coalesce("own", "label").alias("label")
        )
        before = best.select(*keys, "node", F.col("label").alias("old"))
        step = materialise(jumped.join(before, [*keys, "node"]))
        best = step.drop("old")
        if step.where("label <> old").isEmpty():
            break
    return (
        local.join(best.withColumnRenamed("node", "__local").withColumnRenamed("label", "__merged"), [*keys, "__local"], "left")
        .withColumn("label", F.coalesce("__merged", "__local"))
        .drop("__merged")
    )
