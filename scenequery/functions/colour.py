"""Columns of colours and exposures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rgb = tuple[Column, Column, Column]

#: Weights of red, green and blue; the sRGB primaries; the D65 white point; the knee of the cube-root curve.
GRAY = (0.299, 0.587, 0.114)
GRAY_LINEAR = (0.2126, 0.7152, 0.0722)
TO_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9504))
WHITE = (0.9505, 1.0, 1.0890)
KNEE, KNEE_ROOT, SLOPE, OFFSET = 0.008856, 0.2069, 0.1284, 0.1379

#: Light sources of EXIF and their temperatures in kelvin.
KELVIN = {1: 5500.0, 2: 4150.0, 3: 2850.0, 4: 5500.0, 9: 5500.0, 10: 6500.0, 11: 7500.0, 12: 6400.0, 13: 5050.0, 14: 4150.0, 15: 3525.0, 16: 2925.0, 17: 2850.0, 18: 5500.0, 19: 6500.0, 20: 5500.0, 21: 6500.0, 22: 7500.0, 23: 5000.0, 24: 3200.0}


def _weighted(rgb: Rgb, weights) -> Column:
    return rgb[0] * weights[0] + rgb[1] * weights[1] + rgb[2] * weights[2]


def gray(rgb: Rgb) -> Column:
    return _weighted(rgb, GRAY)


def gray_linear(rgb: Rgb) -> Column:
    return _weighted(rgb, GRAY_LINEAR)


def rgb_to_xyz(rgb: Rgb) -> Rgb:
    """XYZ times the white point."""
    return tuple(_weighted(rgb, row) * w for row, w in zip(TO_XYZ, WHITE))


def _root(t: Column) -> Column:
    return F.when(t > KNEE, F.cbrt(t)).otherwise(t / SLOPE + OFFSET)


def _cube(t: Column) -> Column:
    return F.when(t > KNEE_ROOT, t * t * t).otherwise(SLOPE * (t - OFFSET))


def xyz_to_lab(xyz: Rgb) -> Rgb:
    """L, a and b, each a hundredth."""
    x, y, z = map(_root, xyz)
    return (116 * y - 16) / 100, 5 * (x - y), 2 * (y - z)


def lab_to_xyz(lab: Rgb) -> Rgb:
    y = (lab[0] * 100 + 16) / 116
    return _cube(y + lab[1] / 5), _cube(y), _cube(y - lab[2] / 2)


def rgb_to_lab(rgb: Rgb) -> Rgb:
    return xyz_to_lab(rgb_to_xyz(rgb))


def in_hsv_range(rgb: Rgb, hue: float, hue_range: float, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Whether hue (a share of the circle), saturation and value lie in their ranges; the hue's range may go round."""
    top, bottom = F.greatest(*rgb), F.least(*rgb)
    span = top - bottom
    r, g, b = rgb
    h = F.when(span == 0, 0.0).when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4) / 6
    h = h - F.floor(h)
    s = F.when(top == 0, 0.0).otherwise(span / top)
    away = F.abs(h - hue)
    return (F.least(away, 1 - away) <= hue_range) & s.between(low[0], high[0]) & top.between(low[1], high[1])


def kelvin(light: Column) -> Column:
    """The temperature of an EXIF light source; 0 for those that have none."""
    out = F.lit(0.0)
    for k, v in KELVIN.items():
        out = F.when(light == k, v).otherwise(out)
    return out


def falling(low: float, high: float, width: float, middle: float, x: Column) -> Column:
    """A sigmoid from high down to low about `middle`."""
    return low + (high - low) / (1 + F.exp(10 * (x - middle) / width))


def rising(low: float, high: float, width: float, middle: float, x: Column) -> Column:
    return low + (high - low) / (1 + F.exp(10 * (middle - x) / width))


def exposure(shutter: Column, aperture: Column, iso: Column, reference_iso: float = 100.0, reference_aperture: float = 1.0) -> Column:
    """shutter * (reference / (aperture * sqrt(iso / reference_iso))) ** 2.

    A missing shutter is 1/200 and a missing aperture the reference's, or 2; -1 where both miss;
    an iso that misses counts as the reference's.  What is not positive is missing.
    """
    has = lambda x: F.coalesce(x > 0, F.lit(False))
    known = reference_aperture > 0
    s = F.when(has(shutter), shutter).otherwise(1 / 200)
    f = F.when(has(aperture), aperture).otherwise(reference_aperture if known else 2.0)
    gain = F.when(F.coalesce(iso > 1e-6, F.lit(False)) & F.lit(reference_iso > 1e-6), iso / reference_iso).otherwise(1.0)
    wide = (F.lit(reference_aperture) if known else f) / f
    return F.when(has(shutter) | has(aperture), s * wide * wide / gain).otherwise(-1.0)


def exposure_value(shutter: Column, aperture: Column, iso: Column) -> Column:
    """log2(1 / exposure); null where nothing is known."""
    e = exposure(shutter, aperture, iso)
    return F.when(e > 0, F.log2(1 / e))
