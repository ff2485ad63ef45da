"""Seeded search for a circular outline among a few hundred points."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenflow.functions.circle import circumcircles

# Fixed values of the outline search.
SAMPLES = 256
POINT_LIMIT = 192
SECTORS = 16
MIN_COVERAGE = 9
MIN_SUPPORT = 12
MIN_SEED_SUPPORT = 4
SEED = 123
#: Distances held at once; larger arrays are allocated and cleared by the system for every search.
BLOCK_PAIRS = 1 << 13
#: Circles that are scored before the others are compared with the best of them.
FIRST_CIRCLES = 16
# Fixed constants of the SplitMix64 generator.
GOLDEN = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB

OUTLINE_TYPE = "x double, y double, radius double, coverage int, support int"


def splitmix64(seed: int, count: int) -> np.ndarray:
    """The first ``count`` outputs of the generator; state advances by a constant, so it vectorises."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
        return z ^ (z >> np.uint64(31))


@lru_cache(maxsize=1)
def _draws() -> np.ndarray:
    return (splitmix64(SEED, 3 * SAMPLES) >> np.uint64(32)).reshape(SAMPLES, 3)


def _below(draw: np.ndarray, limit: int) -> np.ndarray:
    return ((draw * np.uint64(limit)) >> np.uint64(32)).astype(np.int64)


def _on_circles(sample: np.ndarray, cx: np.ndarray, cy: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Per circle and point: whether the point lies on the circle, within the tolerance."""
    tolerance = np.maximum(1.5, 0.05 * radius)
    low, high = (radius - tolerance) ** 2, (radius + tolerance) ** 2
    x, y = sample[:, 0].copy(), sample[:, 1].copy()
    on = np.empty((len(cx), len(sample)), dtype=bool)
    step = max(1, BLOCK_PAIRS // len(sample))
    for k in range(0, len(cx), step):
        few = slice(k, k + step)
        dx, dy = x - cx[few, None], y - cy[few, None]
        squared = dx * dx + dy * dy
        on[few] = (squared >= low[few, None]) & (squared <= high[few, None])
    return on


def _coverage(sample: np.ndarray, on: np.ndarray, cx: np.ndarray, cy: np.ndarray, support: np.ndarray) -> np.ndarray:
    """Sectors of each circle that hold a point; every circle has some."""
    circle, point = np.nonzero(on)
    dx, dy = sample[point, 0] - cx[circle], sample[point, 1] - cy[circle]
    turn = (np.arctan2(dy, dx) + math.pi) * SECTORS / math.tau
    bit = np.left_shift(1, turn.astype(np.int64) % SECTORS)
    return np.bitwise_count(np.bitwise_or.reduceat(bit, np.cumsum(support) - support))


def search_outline(seeds: np.ndarray, others: np.ndarray, centre, extent: float):
    """Best circle through one seed and two points of either kind, or None.

    A circle scores by its support, weighted by how much of its circumference is covered.
    """
    if len(seeds) < MIN_SEED_SUPPORT:
        return None
    sample = np.concatenate([seeds, others])
    draw = _draws()
    a = sample[_below(draw[:, 0], len(seeds))]
    b = sample[_below(draw[:, 1], len(sample))]
    c = sample[_below(draw[:, 2], len(sample))]
    cx, cy, radius, cross, _ = circumcircles(a, b, c)
    largest = max(64.0, 1.4 * extent + 6)
    ok = (np.abs(cross) > 1) & (radius >= 3) & (radius <= largest)
    ok &= np.hypot(cx - centre[0], cy - centre[1]) < radius + 6
    if not ok.any():
        return None
    cx, cy, radius = cx[ok], cy[ok], radius[ok]
    on = _on_circles(sample, cx, cy, radius)
    support = on.sum(axis=1)
    seed_support = on[:, : len(seeds)].sum(axis=1)
    enough = np.flatnonzero((support >= MIN_SUPPORT) & (seed_support >= MIN_SEED_SUPPORT))
    weight, root = support + 2 * seed_support, np.sqrt(radius)
    # A full circumference is the most a circle can score: those that cannot win are not looked at.
    most = weight * root
    enough = enough[np.argsort(-most[enough], kind="stable")]
    coverage, score = np.zeros(len(cx), dtype=np.int64), np.full(len(cx), -1.0)
    for few in (enough[:FIRST_CIRCLES], enough[FIRST_CIRCLES:]):
        few = few[most[few] >= score.max()]
        if len(few):
            coverage[few] = _coverage(sample, on[few], cx[few], cy[few], support[few])
            few = few[coverage[few] >= MIN_COVERAGE]
            score[few] = weight[few] * (coverage[few] / SECTORS) ** 4 * root[few]
    best = int(np.argmax(score))
    if score[best] < 0:
        return None
    return (cx[best], cy[best], radius[best], int(coverage[best]), int(support[best]))


def outline_udf():
    """Pandas UDF over seed and other point arrays, centre and extent; a null radius means none."""
    names = [part.split()[0] for part in OUTLINE_TYPE.split(", ")]

    @F.pandas_udf(OUTLINE_TYPE)
    def search(
        seed_x: pd.Series, seed_y: pd.Series, other_x: pd.Series, other_y: pd.Series,
        x: pd.Series, y: pd.Series, extent: pd.Series,
    ) -> pd.DataFrame:
        rows = []
        for sx, sy, ox, oy, cx, cy, size in zip(seed_x, seed_y, other_x, other_y, x, y, extent):
            seeds, others = np.column_stack([sx, sy]), np.column_stack([ox, oy])
            rows.append(search_outline(seeds, others, (cx, cy), size) or (None,) * 5)
        return pd.DataFrame(rows, columns=names)

    # Not to be copied into filters, which would run the search twice.
    return search.asNondeterministic()
