"""Cluster proposals in the newest foreground events of a window."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenflow.config import CameraModel
from lumenflow.functions.label import connected
from lumenflow.operators.components import _starts

#: Fixed value: only this newest part of a window forms proposals.
DETECT_US = 10_000


@dataclass(frozen=True)
class ProposalLimits:
    """The defaults are the tracker's fixed values."""

    count: int = 6
    cell_px: int = 3
    min_events: int = 15
    min_cells: int = 3
    max_extent_px: int = 800


PROPOSAL_TYPE = (
    "stream_id string, window_id long, rank int, centroid_x double, centroid_y double, "
    "min_x int, min_y int, max_x int, max_y int, event_count long"
)


def foreground_pixels(rows: DataFrame, camera: CameraModel) -> DataFrame:
    """Newest foreground events per window and rounded pixel, counted before any shuffle."""

    def pixel(name: str, limit: int):
        return F.least(F.greatest(F.floor(F.col(name) + 0.5), F.lit(0)), F.lit(limit - 1)).cast("int")

    return (
        rows.where(F.col("foreground") & (F.col("timestamp_us") >= F.col("end_us") - DETECT_US))
        .groupBy(
            "stream_id",
            "window_id",
            pixel("px", camera.width).alias("x"),
            pixel("py", camera.height).alias("y"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    )


def propose(pixels: DataFrame, limits: ProposalLimits = ProposalLimits()) -> DataFrame:
    """A few clusters per window, largest first.

    Each cluster removes all pixels in its bounding box before the next search. Pixels are counts,
    so a window has at most one row per sensor pixel; many windows are searched per Arrow batch.
    """
    keys = ["stream_id", "window_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            cut = int(_starts(table, keys)[-1])
            if cut:
                yield from _search(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from _search(pa.Table.from_batches(held))

    def _search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = _starts(table, keys)
        group = np.zeros(table.num_rows, dtype=np.int64)
        group[starts[1:]] = 1
        found = largest_boxes(
            np.cumsum(group),
            *(table.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "n", "first_seq")),
            limits,
        )
        at = pa.array(starts[found["group"]])
        columns = [table.column(k).take(at).combine_chunks() for k in keys]
        columns += [
            pa.array(found[c].astype(kind))
            for c, kind in (
                ("rank", "int32"),
                ("x", "float64"),
                ("y", "float64"),
                ("min_x", "int32"),
                ("min_y", "int32"),
                ("max_x", "int32"),
                ("max_y", "int32"),
                ("n", "int64"),
            )
        ]
        names = [part.split()[0] for part in PROPOSAL_TYPE.split(", ")]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return pixels.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, PROPOSAL_TYPE)


def largest_boxes(group, x, y, n, first_seq, limits: ProposalLimits) -> dict[str, np.ndarray]:
    """Repeated search for the largest cluster of every group; ties go to the earliest event."""
    found: list[dict[str, np.ndarray]] = []
    for rank in range(1, limits.count + 1):
        enough = np.bincount(group, weights=n, minlength=1) >= limits.min_events
        alive = enough[group] if len(group) else np.zeros(0, dtype=bool)
        group, x, y, n, first_seq = (v[alive] for v in (group, x, y, n, first_seq))
        if not len(group):
            break
        best = _largest(group, x, y, n, first_seq, limits)
        if not len(best["group"]):
            break
        best["rank"] = np.full(len(best["group"]), rank)
        found.append(best)
        # Groups without a cluster are finished; the others lose the pixels in the box.
        slot = np.full(int(group.max()) + 1, -1)
        slot[best["group"]] = np.arange(len(best["group"]))
        at = slot[group]
        inside = (
            (x >= best["min_x"][at])
            & (x <= best["max_x"][at])
            & (y >= best["min_y"][at])
            & (y <= best["max_y"][at])
        )
        rest = (at >= 0) & ~inside
        group, x, y, n, first_seq = (v[rest] for v in (group, x, y, n, first_seq))
    names = ("group", "rank", "x", "y", "min_x", "min_y", "max_x", "max_y", "n")
    return {k: np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in names}


def _largest(group, x, y, n, first_seq, limits: ProposalLimits) -> dict[str, np.ndarray]:
    cell_x, cell_y = x // limits.cell_px, y // limits.cell_px
    cells, cell_at = np.unique(np.stack([group, cell_x, cell_y]), axis=1, return_inverse=True)
    _, cluster_of_cell = np.unique(connected(*cells), return_inverse=True)
    cluster = cluster_of_cell[cell_at.ravel()]
    order = np.argsort(cluster, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(cluster[order]) > 0])
    rows = np.bincount(cluster_of_cell)

    def reduce(operation, values):
        return operation.reduceat(values[order], edges)

    count = reduce(np.add, n)
    box = {
        "min_x": reduce(np.minimum, x),
        "min_y": reduce(np.minimum, y),
        "max_x": reduce(np.maximum, x),
        "max_y": reduce(np.maximum, y),
    }
    ok = (
        (count >= limits.min_events)
        & (rows >= limits.min_cells)
        & (box["max_x"] - box["min_x"] < limits.max_extent_px)
        & (box["max_y"] - box["min_y"] < limits.max_extent_px)
    )
    owner = reduce(np.minimum, group)
    ranked = np.lexsort((reduce(np.minimum, first_seq), -count, owner))
    ranked = ranked[ok[ranked]]
    first = ranked[np.r_[True, np.diff(owner[ranked]) > 0]] if len(ranked) else ranked
    return {
        "group": owner[first],
        "x": reduce(np.add, x * n)[first] / count[first],
        "y": reduce(np.add, y * n)[first] / count[first],
        **{k: v[first] for k, v in box.items()},
        "n": count[first],
    }
