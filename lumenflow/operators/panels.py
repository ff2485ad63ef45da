"""Image-like tables: densities, last colour per pixel, foreground over background counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def density_level(count: Column) -> Column:
    """Brightness ``255 (1 - e^(-n/2))``, truncated; counts above 255 are saturated long before."""
    n = F.least(count, F.lit(255))
    return F.floor(F.lit(255.0) * (1 - F.exp(-n / 2.0))).cast("int")


def density_panel(
    points: DataFrame, keys: list[str], width: int, height: int, x: str = "x", y: str = "y", mask: Column | None = None
) -> DataFrame:
    """Counts and brightness per 2 x 2 pixel bin; ``mask`` keeps only some points."""
    inside = (F.col(x) >= 0) & (F.col(y) >= 0) & (F.col(x) < width) & (F.col(y) < height)
    kept = points.where(inside if mask is None else inside & mask)
    return (
        kept.groupBy(
            *keys,
            F.floor(F.floor(F.col(x)) / 2).cast("int").alias("bx"),
            F.floor(F.floor(F.col(y)) / 2).cast("int").alias("by"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("level", density_level(F.col("n")))
    )


def comparison_panels(rows: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """The four panels of a motion comparison: compensation off / on, all events / foreground.

    Expects ``ox, oy, px, py, foreground_off, foreground_on``. One pass over the events.
    """
    panel = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("panel"), F.col(x).alias("x"), F.col(y).alias("y"), keep.alias("keep"))
                for i, (x, y, keep) in enumerate(
                    (
                        ("ox", "oy", F.lit(True)),
                        ("px", "py", F.lit(True)),
                        ("ox", "oy", F.col("foreground_off")),
                        ("px", "py", F.col("foreground_on")),
                    )
                )
            ]
        )
    )
    flat = rows.select(*keys, panel.alias("p")).select(*keys, "p.*")
    return density_panel(flat, [*keys, "panel"], width, height, mask=F.col("keep"))


# Fixed colours: accepted and rejected events by polarity.
COLOURS = {(True, True): 0xFFFFFF, (True, False): 0x3060FF, (False, True): 0x404040, (False, False): 0x182040}


def polarity_raster(
    events: DataFrame, keys: list[str], width: int, height: int, invert: bool = True, show_rejected: bool = True
) -> DataFrame:
    """Colour of the newest event per pixel; expects an ``accepted`` column."""
    positive = F.col("polarity") != F.lit(invert)

    def colour(accepted: bool) -> Column:
        return F.when(positive, COLOURS[accepted, True]).otherwise(COLOURS[accepted, False])

    shown = events.where((F.col("x") < width) & (F.col("y") < height))
    if not show_rejected:
        shown = shown.where("accepted")
    value = F.when(F.col("accepted"), colour(True)).otherwise(colour(False))
    return shown.groupBy(*keys, "x", "y").agg(F.max_by(value, "seq").alias("colour"))


def foreground_canvas(rows: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Saturating foreground and background counts per pixel; foreground wins where both exist."""
    inside = (F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < width) & (F.col("py") < height)

    def held(condition: Column) -> Column:
        return F.least(F.count_if(condition), F.lit(255)).cast("int")

    return (
        rows.where(inside)
        .groupBy(*keys, F.floor("px").cast("int").alias("x"), F.floor("py").cast("int").alias("y"))
        .agg(held(F.col("foreground")).alias("front"), held(~F.col("foreground")).alias("back"))
        .withColumn("shown", F.when(F.col("front") > 0, F.col("front")).otherwise(F.col("back")))
        .withColumn("is_front", F.col("front") > 0)
    )
