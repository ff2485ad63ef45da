"""Mix sources to target weights by systematic sampling.

Documents of a source are put in a fixed order (size class, then a hash, then doc_id). Each expects
``rate = target / source size`` copies; the running sum of these expectations plus one random offset
per source crosses integers, and each crossing emits the document once. Because like sizes stand
next to each other in that order, the words taken come near the target; of a few random offsets the
one that comes nearest is used, which matters where a source has few documents.

Ranks come in two steps: documents are counted per (source, class, hash bucket), the counts are
summed over the small bucket table, and rows are numbered within their bucket only, so no source,
however large, is sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.llm.store import saved


@dataclass(frozen=True)
class MixConfig:
    """``weights`` repeat over the sources by code point, null last; ``repeats`` bounds the copies of one.

    ``offsets``: random offsets tried per source. ``buckets``: hash buckets per size class.
    """

    weights: tuple[int, ...] = (1, 2, 3)
    repeats: int = 3
    seed: int = 7
    buckets: int = 1024
    offsets: int = 16


def words_in(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D; null has none."""
    found = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return F.when(text.isNull(), F.lit(0)).otherwise(found).cast("long")


def _unit(value: Column, seed: int) -> Column:
    """32 random bits that depend on the value alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), value)), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """(source, source_size) -> target words per source.

    One row per source. Sources are filled in the order in which rising shares reach their limit
    ``repeats * source_size``; what those cannot take is shared by weight among the rest.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.lit(list(config.weights)), (F.col("place") % len(config.weights) + 1).cast("int"))
    table = sizes.select("source", F.col("source_size").cast("long"), (F.row_number().over(order) - 1).alias("place"))
    table = table.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * config.repeats)
    every = Window.orderBy(F.col("most") / F.col("weight"), "place")
    whole = Window.partitionBy()
    table = table.select(
        "*",
        F.sum("source_size").over(whole).alias("all_size"),
        F.sum("weight").over(whole).alias("all_weight"),
        F.coalesce(F.sum("most").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("held"),
        F.coalesce(F.sum("weight").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("gone"),
    )
    level = (F.col("all_size") - F.col("held")).cast("double") / (F.col("all_weight") - F.col("gone"))
    table = table.withColumn("level", level)
    is_open = F.col("level") * F.col("weight") <= F.col("most")
    # the level rises while full sources are set aside, and falls from the first that stays open
    table = table.withColumn("final_level", F.max(F.when(is_open, F.col("level"))).over(whole))
    share = F.least(F.col("final_level") * F.col("weight"), F.col("most").cast("double"))
    return table.select("source", "source_size", F.coalesce(share, F.col("most").cast("double")).alias("target"))


def _keyed(sized: DataFrame, config: MixConfig) -> DataFrame:
    leading = F.conv(F.substring(F.bin("size"), 1, 5), 2, 10).cast("int")
    grade = F.length(F.bin("size")) * 32 + leading
    bucket = _unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), config.seed) % config.buckets
    keyed = sized.withColumn("grade", grade).withColumn("bucket", bucket)
    order = Window.partitionBy("source", "grade", "bucket").orderBy("doc_id", "size")
    return keyed.withColumn("rank", F.row_number().over(order))


def _place(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("source", "grade", "bucket")]
    other = [c for c in plan.columns if c not in ("source", "grade", "bucket")]
    joined = keyed.alias("k").join(plan.alias("p"), same[0] & same[1] & same[2])
    return joined.select("k.*", *other).withColumn("place", F.col("start") + F.col("rank"))


def _count(offset: Column) -> Column:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (F.floor(rate * F.col("place") + offset) - F.floor(rate * (F.col("place") - 1) + offset)).cast("long")


def plan(sized: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """Per bucket (source, grade, bucket): its first place, source_size, target and the source's offset."""
    keyed = _keyed(sized, config)
    keys = ["source", "grade", "bucket"]
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    sizes = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    before = Window.partitionBy("source").orderBy(F.desc("grade"), "bucket")
    starts = counts.select(*keys, (F.sum("n").over(before) - F.col("n")).alias("start"))
    goal = targets(sizes, config)
    table = saved(
        starts.alias("s")
        .join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
        .select("s.*", "source_size", "target")
    )
    tries = [
        _unit(F.coalesce(F.concat(F.lit(f"{k}s"), F.col("source")), F.lit(f"{k}null")), config.seed) / float(1 << 32)
        for k in range(config.offsets)
    ]
    taken = _place(keyed, table).groupBy("source", "target").agg(
        *[F.sum(_count(offset) * F.col("size")).alias(f"taken_{k}") for k, offset in enumerate(tries)]
    )
    misses = [
        F.struct(F.abs(F.col(f"taken_{k}") - F.col("target")).alias("miss"), F.lit(k).alias("k"), offset.alias("offset"))
        for k, offset in enumerate(tries)
    ]
    best = taken.select(F.col("source"), F.array_min(F.array(*misses))["offset"].alias("offset"))
    return (
        table.alias("t")
        .join(best.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")))
        .select("t.*", "offset")
    )


def copies(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target and copies.

    Every row takes part, repeated rows each on their own; a null source is a source; a row without
    words has size 0 and takes no words. Rows with equal id and size may exchange copies. An empty
    table gives an empty one.
    """
    sized = saved(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")))
    placed = _place(_keyed(sized, config), plan(sized, config))
    return placed.select("doc_id", "size", "source_size", "target", _count(F.col("offset")).alias("copies"))


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mixed corpus: each document as often as the sample emits it, with the columns of ``docs``."""
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), columns)
    placed = _place(_keyed(rows, config), plan(saved(rows.drop("row")), config))
    taken = placed.select("row", _count(F.col("offset")).alias("copies")).filter(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
