"""Column math: projection and distortion, geodesy, exposure, patterns, pyramids."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def pinhole(x: Column, y: Column, z: Column, f: float, px: float, py: float) -> tuple[Column, Column]:
    return F.lit(f) * x / z + px, F.lit(f) * y / z + py


def radial(u: Column, v: Column, *k: float) -> tuple[Column, Column]:
    """Radial polynomial in r squared."""
    r2 = u * u + v * v
    s, p = F.lit(1.0), F.lit(1.0)
    for c in k:
        p = p * r2
        s = s + F.lit(c) * p
    return u * s, v * s


def brown(u: Column, v: Column, k: tuple[float, float, float], t: tuple[float, float]) -> tuple[Column, Column]:
    """Radial plus tangential terms."""
    a, b = radial(u, v, *k)
    r2 = u * u + v * v
    return a + t[1] * (r2 + 2 * u * u) + 2 * t[0] * u * v, b + t[0] * (r2 + 2 * v * v) + 2 * t[1] * u * v


def fisheye(u: Column, v: Column, k: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Odd polynomial in the angle of the ray."""
    r = F.sqrt(u * u + v * v)
    a = F.atan(r)
    t2 = a * a
    d = a * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))
    s = F.when(r > 1e-8, d / r).otherwise(1.0)
    return u * s, v * s


def equidistant(x: Column, y: Column, z: Column, radius: float) -> tuple[Column, Column]:
    """Distance from the centre in proportion to the ray's angle."""
    a, at = F.atan2(F.sqrt(x * x + y * y), z), F.atan2(y, x)
    return F.lit(radius) * a * F.cos(at), F.lit(radius) * a * F.sin(at)


def geodetic_to_ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Degrees and metres to Earth-centred metres, on the ellipsoid of 6378137 m and a flattening of 1 / 298.257222101."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    la, lo = F.radians(lat), F.radians(lon)
    n = F.lit(a) / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
    return (n + alt) * F.cos(la) * F.cos(lo), (n + alt) * F.cos(la) * F.sin(lo), (n * (1 - e2) + alt) * F.sin(la)


def glob_pattern(glob: str) -> str:
    """A pattern for *, ?, # (a digit) and @ (digits); all else stands for itself."""
    return "^" + "".join({"*": ".*", "?": ".", "#": "[0-9]", "@": "[0-9]+"}.get(c, re.escape(c)) for c in glob) + "$"
