"""Circular outlines around cluster proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lumenflow.config import CameraModel
from lumenflow.functions.geometry import bbox_height, bbox_width
from lumenflow.functions.outline import POINT_LIMIT, outline_udf
from lumenflow.plans.ordered import spread

# Which proposals are searched, and where.
OUTLINE_US = 4_000
MAX_EXTENT_PX = 400
MIN_EVENTS = 30
MIN_POINTS = 15
CELL_PX = 1.5
#: Join key granularity for points around a proposal.
TILE_PX = 64
KEYS = ["stream_id", "window_id"]


def recent_points(rows: DataFrame, camera: CameraModel) -> DataFrame:
    """Newest events of each window with their position and foreground flag."""
    return rows.where(
        (F.col("timestamp_us") >= F.col("end_us") - OUTLINE_US)
        & F.col("px").between(0, camera.width - 1)
        & F.col("py").between(0, camera.height - 1)
    ).select(*KEYS, "seq", "px", "py", "foreground")


def outline_points(proposals: DataFrame, points: DataFrame, camera: CameraModel) -> DataFrame:
    """Deduplicated points around each searchable proposal: ``is_seed``, position, cell.

    Proposals are spread over the tiles their search box touches and points carry their own tile,
    so the match is an equi join; the duplicates per 1.5 px cell collapse map-side.
    """
    w, h = bbox_width(), bbox_height()
    x, y = F.col("centroid_x"), F.col("centroid_y")
    sized = proposals.withColumn("extent", F.greatest(w, h).cast("double")).withColumn(
        "pad", F.greatest(F.lit(72.0), F.col("extent") * 1.1 + 12)
    )
    clear = F.least(x, F.lit(camera.width) - x, y, F.lit(camera.height) - y)
    searched = sized.where(
        (F.col("extent") <= MAX_EXTENT_PX)
        & (F.col("event_count") >= MIN_EVENTS)
        & (clear >= F.col("extent") * 0.5 + 3)
    )

    def tiles(centre, pad):
        return F.sequence(
            F.floor((centre - pad) / TILE_PX).cast("int"), F.floor((centre + pad) / TILE_PX).cast("int")
        )

    boxes = searched.select(
        *KEYS, "rank", "centroid_x", "centroid_y", "extent", "pad", w.alias("w"), h.alias("h")
    )
    boxes = boxes.withColumn("tx", F.explode(tiles(x, F.col("pad")))).withColumn(
        "ty", F.explode(tiles(y, F.col("pad")))
    )
    placed = points.withColumn("tx", F.floor(F.col("px") / TILE_PX).cast("int")).withColumn(
        "ty", F.floor(F.col("py") / TILE_PX).cast("int")
    )
    near = placed.join(boxes, [*KEYS, "tx", "ty"]).where(
        (F.abs(F.col("px") - x) < F.col("pad")) & (F.abs(F.col("py") - y) < F.col("pad"))
    )
    own = ["centroid_x", "centroid_y", "extent", "w", "h"]
    single = near.groupBy(
        *KEYS,
        "rank",
        F.rint(F.col("px") / CELL_PX).cast("int").alias("gx"),
        F.rint(F.col("py") / CELL_PX).cast("int").alias("gy"),
    ).agg(
        *[F.min_by(c, "seq").alias(c) for c in ("px", "py", "foreground")],
        F.count(F.lit(1)).alias("n"),
        *[F.first(c).alias(c) for c in own],
    )
    seed = (
        F.col("foreground")
        & (F.abs(F.col("px") - x) < F.col("w") * 0.75 + 3)
        & (F.abs(F.col("py") - y) < F.col("h") * 0.75 + 3)
    )
    return single.withColumn("is_seed", seed)


def evenly_spaced(points: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows per key, evenly spaced over the order, both ends included."""
    every = Window.partitionBy(*keys)
    numbered = points.withColumn("__r", F.row_number().over(every.orderBy(*order)) - 1).withColumn(
        "__last", F.count(F.lit(1)).over(every) - 1
    )
    r, last = F.col("__r"), F.col("__last")
    # Row r is picked when some slot i has floor(i * last / (limit - 1)) = r.
    slot = F.floor((r * (limit - 1) + last - 1) / F.greatest(last, F.lit(1)))
    hit = F.floor(slot * last / F.lit(limit - 1)) == r
    return numbered.where((last < limit) | (r == last) | hit).drop("__r", "__last")


def outlines(proposals: DataFrame, points: DataFrame, camera: CameraModel) -> DataFrame:
    """Outline per proposal ``(stream_id, window_id, rank)``; proposals without one are absent."""
    # A window's points are dealt to one task before they are matched, so no file split counts them for all its windows.
    # After that one partitioning serves the counts, the sampling, the lists and the search.
    group = [*KEYS, "rank"]
    around = spread(outline_points(proposals, spread(points, KEYS), camera), group)
    total = F.sum("n").over(Window.partitionBy(*group))
    dense = around.withColumn("points", total).where(F.col("points") >= MIN_POINTS)
    sampled = evenly_spaced(dense, [*group, "is_seed"], ["gx", "gy"], POINT_LIMIT)
    placed = F.struct("gx", "gy", "px", "py")
    lists = sampled.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.when(F.col("is_seed"), placed))).alias("s"),
        F.sort_array(F.collect_list(F.when(~F.col("is_seed"), placed))).alias("o"),
        *[F.first(c).alias(c) for c in ("centroid_x", "centroid_y", "extent")],
    )
    searched = lists.where(F.size("s") >= 4).withColumn(
        "outline", outline_udf()("s.px", "s.py", "o.px", "o.py", "centroid_x", "centroid_y", "extent")
    )
    return searched.where("outline.radius is not null").select(*group, "outline")


def candidates(proposals: DataFrame, found: DataFrame) -> DataFrame:
    """Proposals refined to their outline where one was found."""
    joined = proposals.join(found, [*KEYS, "rank"], "left")
    return joined.select(
        *KEYS,
        "rank",
        F.coalesce("outline.x", "centroid_x").alias("x"),
        F.coalesce("outline.y", "centroid_y").alias("y"),
        F.coalesce(F.col("outline.radius") * 2, bbox_width().cast("double")).alias("width"),
        F.coalesce(F.col("outline.radius") * 2, bbox_height().cast("double")).alias("height"),
        F.col("event_count").alias("events"),
        "outline",
    )
