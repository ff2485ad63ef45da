"""Camera, rotation and ball geometry as column expressions.

Vectors are tuples of columns and matrices are 3-tuples of vectors. Helpers that reuse their
inputs several times work on named columns, so Catalyst keeps one evaluation of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenflow.config import CameraModel
from lumenflow.plans.fence import fence

Vec = tuple[Column, ...]
Mat = tuple[Vec, Vec, Vec]
FLOAT32_EPSILON = 1.1920929e-07


def lit_matrix(rows) -> Mat:
    return tuple(tuple(F.lit(float(v)) for v in row) for row in rows)


def rotate(m: Mat, v: Vec) -> Vec:
    return tuple(sum((row[k] * v[k] for k in range(1, 3)), row[0] * v[0]) for row in m)


def transpose(m: Mat) -> Mat:
    return tuple(tuple(m[j][i] for j in range(3)) for i in range(3))


def multiply(a: Mat, b: Mat) -> Mat:
    return transpose(tuple(rotate(a, column) for column in transpose(b)))


def norm(v: Vec) -> Column:
    return F.sqrt(sum((c * c for c in v[1:]), v[0] * v[0]))


def lerp(a: Vec, b: Vec, w: Column) -> Vec:
    return tuple(p * (1 - w) + q * w for p, q in zip(a, b))


def quaternion_of(angle: Vec) -> Vec:
    """Unit quaternion of a rotation vector; the small-angle factor is exactly one half."""
    size = norm(angle)
    factor = F.when(size < 1e-12, F.lit(0.5)).otherwise(F.sin(size * 0.5) / size)
    return (F.cos(size * 0.5), *(v * factor for v in angle))


def quaternion_product(a: Vec, b: Vec) -> Vec:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    )


def quaternion_matrix(q: Vec) -> Mat:
    w, x, y, z = q
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )


def quaternion_blend(p: Vec, q: Vec, w: Column) -> Vec:
    """Normalised interpolation on the shorter arc."""
    dot = sum((a * b for a, b in zip(p[1:], q[1:])), p[0] * q[0])
    sign = F.when(dot < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    mixed = lerp(p, tuple(v * sign for v in q), w)
    size = norm(mixed)
    return tuple(v / size for v in mixed)


UNDISTORT_ROUNDS = 8


def undistort(df: DataFrame, camera: CameraModel, x: Column, y: Column) -> DataFrame:
    """Add the undistorted ray ``ray_x, ray_y`` (with z = 1) of a pixel position.

    Fixed-point inversion of the lens model, one projection per round. Without distortion it is
    the plain pinhole ray.
    """
    df = df.withColumn("ray_x", (x - camera.cx) / camera.fx).withColumn(
        "ray_y", (y - camera.cy) / camera.fy
    )
    k1, k2, p1, p2, k3 = camera.distortion
    if all(abs(k) <= FLOAT32_EPSILON for k in camera.distortion):
        return df
    df = df.withColumn("__x0", F.col("ray_x")).withColumn("__y0", F.col("ray_y"))
    rx, ry, r2 = F.col("ray_x"), F.col("ray_y"), F.col("__r2")
    for _ in range(UNDISTORT_ROUNDS):
        df = (
            df.withColumn("__r2", rx * rx + ry * ry)
            .withColumns(
                {
                    "__radial": 1 + r2 * (k1 + r2 * (k2 + r2 * k3)),
                    "__dx": 2 * p1 * rx * ry + p2 * (r2 + 2 * rx * rx),
                    "__dy": p1 * (r2 + 2 * ry * ry) + 2 * p2 * rx * ry,
                }
            )
            .withColumns(
                {
                    "ray_x": (F.col("__x0") - F.col("__dx")) / F.col("__radial"),
                    "ray_y": (F.col("__y0") - F.col("__dy")) / F.col("__radial"),
                }
            )
        )
    df = df.drop("__x0", "__y0", "__r2", "__radial", "__dx", "__dy")
    return df.withColumns({"ray_x": fence(rx), "ray_y": fence(ry)})


def in_image(camera: CameraModel, x: Column, y: Column) -> Column:
    return (x >= 0) & (y >= 0) & (x < camera.width) & (y < camera.height)


def project(camera: CameraModel, ray: Vec) -> tuple[Column, Column]:
    """Pinhole projection; null behind the camera or when not finite."""

    def axis(focal: float, value: Column, centre: float) -> Column:
        # A conditional, so the division never sees a depth of zero in ANSI mode.
        pixel = F.when(ray[2] > 0, F.lit(focal) * value / ray[2] + F.lit(centre))
        return F.when(F.abs(pixel) < F.lit(float("inf")), pixel)

    return axis(camera.fx, ray[0], camera.cx), axis(camera.fy, ray[1], camera.cy)


def guarded_cell(value: Column, limit: int, size: int) -> Column:
    """Grid index of a floating pixel coordinate, null outside ``[0, limit)``."""
    return F.when((value >= 0) & (value < limit), F.floor(F.floor(value) / size).cast("int"))


def ballistic(position: Vec, velocity: Vec, gravity: Vec, t: Column) -> Vec:
    return tuple(p + v * t + 0.5 * g * t * t for p, v, g in zip(position, velocity, gravity))


def clock(us: Column) -> Column:
    """``MM:SS.mmm``"""
    ms = F.floor(us / 1000).cast("long")
    return F.format_string(
        "%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000
    )


def bbox_width() -> Column:
    return F.col("max_x") - F.col("min_x") + 1


def bbox_height() -> Column:
    return F.col("max_y") - F.col("min_y") + 1


def pixel_diameter(source: str, has_circle: bool = True) -> Column:
    """Ball diameter in pixels from one of six sources; a missing circle uses the mean side."""
    w, h = bbox_width(), bbox_height()
    mean = (w + h) / 2.0
    return {
        "circle_fit": F.coalesce(F.col("circle.radius_px") * 2, mean) if has_circle else mean,
        "bbox_width": w.cast("double"),
        "bbox_height": h.cast("double"),
        "bbox_average": mean,
        "bbox_max": F.greatest(w, h).cast("double"),
        "bbox_min": F.least(w, h).cast("double"),
    }[source]
