"""Two-point ballistic fit of a short point buffer with known gravity."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenflow.config import ParabolaConfig

FIT_TYPE = (
    "origin_us long, px double, py double, pz double, vx double, vy double, vz double, "
    "inlier_count int, total_count int, mean_error_m double, max_error_m double, "
    "inliers array<boolean>"
)


@lru_cache(maxsize=256)
def point_pairs(count: int, budget: int) -> np.ndarray:
    """Index pairs i < j; beyond ``budget``, that many at equal distances in the list of all pairs."""
    pairs = np.column_stack(np.triu_indices(count, 1))
    if len(pairs) > budget:
        pairs = pairs[np.arange(budget) * len(pairs) // budget]
    return pairs


def fit_parabola(us: np.ndarray, position: np.ndarray, cfg: ParabolaConfig):
    """Best two-point path by inliers, then mean error; refit by least squares on its inliers.

    At most ``cfg.max_pair_samples`` pairs of points are tried, spread over all pairs.
    """
    n = len(us)
    if n < cfg.min_points:
        return None
    t = np.maximum(us - us[0], 0) * 1e-6
    gravity = np.asarray(cfg.gravity)
    # Without gravity's part every path is a straight line.
    line = position - 0.5 * gravity * (t * t)[:, None]
    at = point_pairs(n, cfg.max_pair_samples)
    dt = t[at[:, 1]] - t[at[:, 0]]
    at, dt = at[np.abs(dt) >= cfg.min_sample_dt_s], dt[np.abs(dt) >= cfg.min_sample_dt_s]
    if not len(at):
        return None
    velocity = (line[at[:, 1]] - line[at[:, 0]]) / dt[:, None]
    start = line[at[:, 0]] - velocity * t[at[:, 0], None]

    def errors(p, v):
        return np.linalg.norm(line - (p[..., None, :] + v[..., None, :] * t[:, None]), axis=-1)

    error = errors(start, velocity)
    inlier = error <= cfg.inlier_threshold_m
    count = inlier.sum(axis=1)
    mean = np.where(inlier, error, 0).sum(axis=1) / np.maximum(count, 1)
    best = int(np.lexsort((np.arange(len(count)), mean, -count))[0])
    needed = max(math.ceil(cfg.min_inlier_ratio * n), cfg.min_points)
    if count[best] < needed:
        return None
    chosen = inlier[best]
    design = np.column_stack([np.ones(chosen.sum()), t[chosen]])
    solution, _, rank, _ = np.linalg.lstsq(design, line[chosen], rcond=None)
    if rank < 2:
        return None
    p, v = solution
    error = errors(p, v)
    inlier = error <= cfg.inlier_threshold_m
    if inlier.sum() < needed:
        return None
    good = error[inlier]
    return (int(us[0]), *p, *v, int(inlier.sum()), n, good.mean(), good.max(), inlier.tolist())


def fit_parabolas(cfg: ParabolaConfig):
    """Pandas UDF over the time and coordinate arrays of a buffer; zero inliers means no fit."""
    names = [part.split()[0] for part in FIT_TYPE.split(", ")]
    nothing = (0, *[None] * 6, 0, 0, None, None, None)

    @F.pandas_udf(FIT_TYPE)
    def fit(us: pd.Series, xs: pd.Series, ys: pd.Series, zs: pd.Series) -> pd.DataFrame:
        rows = [
            fit_parabola(np.asarray(t), np.column_stack([x, y, z]), cfg) or nothing
            for t, x, y, z in zip(us, xs, ys, zs)
        ]
        return pd.DataFrame(rows, columns=names)

    # Not to be copied into filters or field reads, which would run the fit twice.
    return fit.asNondeterministic()
