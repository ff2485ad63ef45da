"""Connected components of links, by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.store import drop, saved

LIMIT = 60  # rounds; each at least halves what is left of a path
CHUNK = 1 << 20  # links that a task contracts at a time


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of one task as (node, smallest node connected to it), one a node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
            a, b = find(root.setdefault(u, u)), find(root.setdefault(v, v))
            root[max(a, b)] = min(a, b)
    pairs = np.array([(x, find(x)) for x in root], np.int64).reshape(-1, 2)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def thinned(links: DataFrame) -> DataFrame:
    """Links (u, v) that connect the same nodes as ``links``, contracted in chunks while that makes them fewer."""
    now = saved(links)
    count = now.count()
    while True:
        parts = count // CHUNK + 1
        after = saved(now.repartition(parts).mapInArrow(_stars, "u long, v long"))
        drop(now)
        now, before, count = after, count, after.count()
        if parts == 1 or count > 0.7 * before:
            return now


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of a link (a, b); the component is its smallest node.

    Links are thinned first, so a crowd of near copies comes with about one link a node and not with
    all that were found. Each round then points every node and its neighbours to the smallest of them, first among larger, then
    among smaller neighbours, until nothing changes. Star-shaped links settle in two rounds.
    """
    pair = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = thinned(pair)
    state = _state(now)
    for _ in range(LIMIT):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        after = saved(small.filter("u <> v").distinct())
        then = _state(after)
        drop(now)
        now = after
        if then == state:
            break
        state = then
    else:
        raise RuntimeError("components did not settle")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def _state(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
