"""Robust circle through a short list of points."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

CIRCLE_TYPE = (
    "center_x double, center_y double, radius_px double, inlier_count int, "
    "inlier_ratio double, mean_error_px double"
)
_EMPTY = (None,) * 6


CORNERS = 24  # points that triples are formed from, spread over all points


@lru_cache(maxsize=256)
def point_triples(count: int) -> np.ndarray:
    """Index triples of at most ``CORNERS`` points at equal distances in the list."""
    corners = np.arange(min(count, CORNERS)) * count // min(count, CORNERS)
    return np.array(list(combinations(corners.tolist(), 3)), dtype=np.int64).reshape(-1, 3)


def circumcircles(a: np.ndarray, b: np.ndarray, c: np.ndarray):
    """Centres and radii through point triples; the mask marks non-degenerate ones."""
    u, v = b - a, c - a
    cross = 2.0 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    ok = np.abs(cross) >= 1e-3
    safe = np.where(ok, cross, 1.0)
    uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    dx = (uu * v[:, 1] - vv * u[:, 1]) / safe
    dy = (vv * u[:, 0] - uu * v[:, 0]) / safe
    return a[:, 0] + dx, a[:, 1] + dy, np.hypot(dx, dy), cross, ok


def fit_circle(x: np.ndarray, y: np.ndarray, tolerance: float) -> tuple:
    """Most inliers wins, then the lower mean error, then the first triple."""
    points = np.column_stack([x, y]).astype(float)
    if len(points) < 6:
        return _EMPTY
    at = point_triples(len(points))
    cx, cy, radius, _, ok = circumcircles(points[at[:, 0]], points[at[:, 1]], points[at[:, 2]])
    ok &= radius >= 1.0
    if not ok.any():
        return _EMPTY
    cx, cy, radius = cx[ok], cy[ok], radius[ok]
    distance = np.hypot(points[:, 0] - cx[:, None], points[:, 1] - cy[:, None])
    error = np.abs(distance - radius[:, None])
    inlier = error <= tolerance
    count = inlier.sum(axis=1)
    mean = np.where(inlier, error, 0.0).sum(axis=1) / np.maximum(count, 1)
    best = int(np.lexsort((np.arange(len(count)), mean, -count))[0])
    ratio = count[best] / len(points)
    if count[best] < 6 or ratio < 0.25:
        return _EMPTY
    return (cx[best], cy[best], radius[best], int(count[best]), ratio, mean[best])


def fit_circles(tolerance: float):
    """Pandas UDF over point arrays; a null centre means no circle."""

    @F.pandas_udf(CIRCLE_TYPE)
    def fit(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        names = [part.split()[0] for part in CIRCLE_TYPE.split(", ")]
        rows = [fit_circle(np.asarray(x), np.asarray(y), tolerance) for x, y in zip(xs, ys)]
        return pd.DataFrame(rows, columns=names)

    # Not to be copied into filters, which would run the fit twice.
    return fit.asNondeterministic()
