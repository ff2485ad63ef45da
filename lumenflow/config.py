"""Validated settings. Every dataclass raises ``InvalidConfig`` on construction."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


class InvalidConfig(ValueError):
    """A setting outside its allowed range."""

    def __init__(self, field_name: str, message: str):
        super().__init__(f"invalid {field_name}: {message}")
        self.field = field_name
        self.message = message


def _positive(prefix: str, obj, *names: str) -> None:
    for name in names:
        if not getattr(obj, name) > 0:
            raise InvalidConfig(prefix + name, "must be positive")


@dataclass(frozen=True)
class PolarityConfig:
    """``mode`` is all, positive or negative; inversion is on by default."""

    mode: str = "all"
    invert: bool = True

    ALIASES = {
        "all": "all",
        "both": "all",
        "positive": "positive",
        "on": "positive",
        "+": "positive",
        "negative": "negative",
        "off": "negative",
        "-": "negative",
    }

    def __post_init__(self):
        if self.mode not in self.ALIASES:
            raise InvalidConfig("polarity", f"unknown mode {self.mode!r}")
        object.__setattr__(self, "mode", self.ALIASES[self.mode])


@dataclass(frozen=True)
class BackgroundConfig:
    radius_px: int = 2
    window_us: int = 5_000
    cleanup_after_us: int | None = None
    #: Planning only: pixel tile side and time slice (in windows) of one shuffle key.
    tile_px: int = 32
    slice_windows: int = 64

    def __post_init__(self):
        _positive("background_", self, "window_us", "tile_px", "slice_windows")
        if self.radius_px < 0:
            raise InvalidConfig("background_radius_px", "must not be negative")
        if self.cleanup_after_us is not None and self.cleanup_after_us < self.window_us:
            raise InvalidConfig("background_cleanup_after_us", "must be at least the time window")


@dataclass(frozen=True)
class StaticConfig:
    cell_size: int = 4
    stable_after_us: int = 250_000
    min_events: int = 200
    inactive_after_us: int | None = 1_000_000
    #: Planning only: ``seq`` values of a stream that share one shuffle key of a hot cell.
    block_rows: int = 1 << 25

    def __post_init__(self):
        _positive("static_", self, "cell_size", "block_rows")
        if self.inactive_after_us is not None:
            _positive("static_", self, "inactive_after_us")


@dataclass(frozen=True)
class ClusterConfig:
    window_us: int = 20_000
    step_us: int = 5_000
    cell_size: int = 2
    min_events: int = 20
    min_cells: int = 3
    max_bbox_width: int = 200
    max_bbox_height: int = 200
    circle_fit: bool = True
    circle_tolerance_px: float = 2.5
    #: Most events a circle is fitted to, spread over all events of the cluster.
    circle_points: int = 96

    def __post_init__(self):
        _positive("", self, "window_us", "step_us", "cell_size", "circle_tolerance_px")


@dataclass(frozen=True)
class CameraModel:
    """Pinhole model with five Brown-Conrady coefficients (k1, k2, p1, p2, k3)."""

    fx: float
    fy: float
    cx: float
    cy: float
    distortion: tuple[float, ...] = (0.0,) * 5
    width: int | None = None
    height: int | None = None

    def for_sensor(self, width: int, height: int) -> "CameraModel":
        """The same model bound to a recording of this size; raises on a mismatch."""
        values = (self.fx, self.fy, self.cx, self.cy, *self.distortion)
        finite = all(abs(v) < float("inf") for v in values)
        if not finite or self.fx <= 0 or self.fy <= 0 or not (0 < width <= 8192 and 0 < height <= 8192):
            raise InvalidConfig("camera", "invalid calibration or image dimensions")
        if self.width not in (None, width) or self.height not in (None, height):
            raise InvalidConfig("camera", "calibration dimensions do not match the recording")
        return replace(self, width=width, height=height)


def default_camera(width: int, height: int) -> CameraModel:
    """Default intrinsics, stated for 640x480 and scaled to the view."""
    width, height = max(width, 1), max(height, 1)
    return CameraModel(410.0 * width / 640.0, 409.0 * height / 480.0, width / 2.0, height / 2.0)


def rescale_default_camera(
    camera: CameraModel, previous: tuple[int, int], current: tuple[int, int]
) -> CameraModel:
    """Follow a view resize, but only in fields that still hold the old default."""
    before, after = default_camera(*previous), default_camera(*current)
    changed = {
        name: getattr(after, name)
        for name in ("fx", "fy", "cx", "cy")
        if getattr(camera, name) == getattr(before, name)
    }
    return replace(camera, **changed)


DIAMETER_SOURCES = (
    "circle_fit",
    "bbox_width",
    "bbox_height",
    "bbox_average",
    "bbox_max",
    "bbox_min",
)


@dataclass(frozen=True)
class BallConfig:
    diameter_m: float = 0.067
    camera: CameraModel = field(default_factory=lambda: CameraModel(410.0, 409.0, 320.0, 240.0))
    diameter_source: str = "circle_fit"
    enabled: bool = True

    def __post_init__(self):
        _positive("ball_", self, "diameter_m")
        _positive("focal_length_", self.camera, "fx", "fy")
        if self.diameter_source not in DIAMETER_SOURCES:
            raise InvalidConfig("ball_diameter_source", f"unknown source {self.diameter_source!r}")


GRAVITY_AXES = {
    "x+": (1.0, 0.0, 0.0),
    "x-": (-1.0, 0.0, 0.0),
    "y+": (0.0, 1.0, 0.0),
    "y-": (0.0, -1.0, 0.0),
    "z+": (0.0, 0.0, 1.0),
    "z-": (0.0, 0.0, -1.0),
}


@dataclass(frozen=True)
class ParabolaConfig:
    camera: CameraModel = field(default_factory=lambda: default_camera(640, 480))
    ball_diameter_m: float = 0.067
    gravity_mps2: float = 9.81
    gravity_axis: str = "y+"
    buffer_len: int = 50
    min_points: int = 4
    max_pair_samples: int = 200
    inlier_threshold_m: float = 0.25
    min_inlier_ratio: float = 0.5
    min_sample_dt_s: float = 0.01
    min_depth_m: float = 0.05
    max_depth_m: float = 30.0

    def __post_init__(self):
        _positive(
            "parabola_",
            self,
            "ball_diameter_m",
            "gravity_mps2",
            "max_pair_samples",
            "inlier_threshold_m",
            "min_sample_dt_s",
            "min_depth_m",
        )
        _positive("parabola_focal_length_", self.camera, "fx", "fy")
        if self.gravity_axis not in GRAVITY_AXES:
            raise InvalidConfig("parabola_gravity_axis", f"unknown axis {self.gravity_axis!r}")
        if self.buffer_len < 2:
            raise InvalidConfig("parabola_buffer_len", "must be at least 2")
        if not 2 <= self.min_points <= self.buffer_len:
            raise InvalidConfig("parabola_min_points", "must be between 2 and buffer_len")
        if not 0 <= self.min_inlier_ratio <= 1:
            raise InvalidConfig("parabola_min_inlier_ratio", "must be between 0 and 1")
        if self.max_depth_m <= self.min_depth_m:
            raise InvalidConfig("parabola_max_depth_m", "must be greater than min_depth_m")

    @property
    def gravity(self) -> tuple[float, float, float]:
        return tuple(self.gravity_mps2 * v for v in GRAVITY_AXES[self.gravity_axis])


IDENTITY = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))


@dataclass(frozen=True)
class MotionConfig:
    """``imu time = camera time + offset_s``; ``mount`` turns IMU axes into camera axes."""

    offset_s: float = 0.0
    mount: tuple = IDENTITY
    cell_px: int = 3
    threshold: float = 0.12
    min_events: int = 3
    min_component_cells: int = 8
    min_new_fraction: float = 0.1
    window_us: int = 30_000
    step_us: int = 10_000

    def __post_init__(self):
        _positive("motion_", self, "cell_px", "min_events", "min_component_cells", "window_us", "step_us")
        if not 0 <= self.min_new_fraction <= 1:
            raise InvalidConfig("motion_min_new_fraction", "must be between 0 and 1")


@dataclass(frozen=True)
class TrackerConfig:
    """3D tracking of a ball of known size."""

    ball_diameter_m: float

    def __post_init__(self):
        if not 0.005 <= self.ball_diameter_m <= 2.0:
            raise InvalidConfig("ball_diameter_m", "must be between 0.005 and 2")
