"""lumenflow: Spark-native analytics for asynchronous, pixel-addressed event streams."""

from lumenflow.config import (
    BackgroundConfig,
    BallConfig,
    ClusterConfig,
    InvalidConfig,
    MotionConfig,
    ParabolaConfig,
    PolarityConfig,
    StaticConfig,
)

__all__ = [
    "BackgroundConfig",
    "BallConfig",
    "ClusterConfig",
    "InvalidConfig",
    "MotionConfig",
    "ParabolaConfig",
    "PolarityConfig",
    "StaticConfig",
]
