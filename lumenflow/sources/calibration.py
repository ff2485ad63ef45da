"""Camera calibration and small text settings."""

from __future__ import annotations

import re

from lumenflow.config import CameraModel, InvalidConfig

NUMBER = re.compile(r"[-+.\deE]+")
MAX_MASKED = 64


def _numbers(text: str) -> list[float]:
    found = []
    for token in NUMBER.findall(text):
        try:
            found.append(float(token))
        except ValueError:
            continue
    return found


def _after(text: str, key: str) -> str | None:
    at = text.find(f'"{key}"')
    return None if at < 0 else text[at + len(key) + 2 :]


def parse_calibration(text: str) -> CameraModel:
    """Tolerant reading: the matrix may be nested or flat, distortion and size are optional."""
    matrix = _after(text, "camera_matrix")
    values = _numbers(matrix.split('"distortion')[0]) if matrix is not None else []
    if len(values) < 6:
        raise InvalidConfig("calibration", "needs a camera_matrix with at least six numbers")
    lens = _after(text, "distortion_coefficients")
    coefficients: list[float] = []
    if lens is not None and "[" in lens and "]" in lens:
        coefficients = _numbers(lens[lens.index("[") : lens.index("]")])
    sizes = {}
    for name in ("width", "height"):
        rest = _after(text, f"image_{name}")
        number = _numbers(rest) if rest is not None else []
        sizes[name] = int(number[0]) if number else None
    distortion = tuple(coefficients[:5]) if len(coefficients) >= 5 else (0.0,) * 5
    return CameraModel(values[0], values[4], values[2], values[5], distortion, **sizes)


def read_calibration(path: str) -> CameraModel:
    with open(path, encoding="utf-8") as file:
        return parse_calibration(file.read())


def parse_pixel_mask(text: str, width: int = 1280, height: int = 720) -> list[tuple[int, int]]:
    """``x:y,x:y`` list of at most 64 pixels inside the sensor."""
    pixels = []
    for part in text.split(","):
        found = re.fullmatch(r"\s*(\d+):(\d+)\s*", part)
        if not found or not (int(found[1]) < width and int(found[2]) < height):
            raise InvalidConfig("mask_pixels", f"bad pixel {part!r}")
        pixels.append((int(found[1]), int(found[2])))
    if len(pixels) > MAX_MASKED:
        raise InvalidConfig("mask_pixels", f"at most {MAX_MASKED} pixels")
    return pixels
