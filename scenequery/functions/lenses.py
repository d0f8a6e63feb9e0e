"""Camera models as column math: scale and offset, distortions and their inverses, projection and rays.

A distortion maps a point of the image plane (at depth 1) to where the lens puts
it; a model's `add` and `remove` undo each other.  A point is a pair of columns.
Distortion models are tuples of a name and its numbers, as in ("radial3", k1, k2, k3).
"""

from __future__ import annotations

from math import tan

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenequery.functions import linear as L

Point = tuple[Column, Column]

# Scale and offset.


def to_pixels(p: Point, scale: tuple[float, float], offset: tuple[float, float], size: tuple[int, int]) -> Point:
    """offset is that of the principal point from the image's middle."""
    return tuple(x * s + (o + n / 2) for x, s, o, n in zip(p, scale, offset, size))


def from_pixels(p: Point, scale: tuple[float, float], offset: tuple[float, float], size: tuple[int, int]) -> Point:
    return tuple((x - (o + n / 2)) / s for x, s, o, n in zip(p, scale, offset, size))


def is_visible(p: Point, size: tuple[int, int]) -> Column:
    return (p[0] >= 0) & (p[0] < size[0]) & (p[1] >= 0) & (p[1] < size[1])


# Distortions.


def _r2(p: Point) -> Column:
    return p[0] * p[0] + p[1] * p[1]


def _polynomial(r2: Column, ks: tuple[float, ...]) -> Column:
    """1 + k1 r2 + k2 r2^2 + ..."""
    out = F.lit(0.0)
    for k in reversed(ks):
        out = (out + k) * r2
    return out + 1


def _times(p: Point, s: Column) -> Point:
    return p[0] * s, p[1] * s


def _fold(state: dict[str, Column], rounds: int, step) -> dict[str, Column]:
    """`rounds` steps over a struct of doubles, inside one row."""
    start = F.struct(*[v.cast("double").alias(k) for k, v in state.items()])
    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: F.struct(*[v.cast("double").alias(k) for k, v in step({k: s[k] for k in state}).items()]))
    return {k: out[k] for k in state}


def radial(p: Point, *ks: float) -> Point:
    return _times(p, _polynomial(_r2(p), ks))


def radial_removed(p: Point, *ks: float, scale: float = 1.0, rounds: int = 60) -> Point:
    """The point that `radial` takes to p, by halving an interval of its squared radius."""
    r2 = _r2(p) * (scale * scale)

    def reach(u: Column) -> Column:
        f = _polynomial(u, ks)
        return u * f * f

    # first an interval that holds the root, by steps of a twentieth
    low = _fold({"u": r2}, 200, lambda s: {"u": F.when(reach(s["u"]) > r2, s["u"] / 1.05).otherwise(s["u"])})["u"]
    high = _fold({"u": r2}, 200, lambda s: {"u": F.when(reach(s["u"]) < r2, s["u"] * 1.05).otherwise(s["u"])})["u"]

    def halve(s):
        middle = (s["low"] + s["high"]) / 2
        over = reach(middle) > r2
        return {"low": F.when(over, s["low"]).otherwise(middle), "high": F.when(over, middle).otherwise(s["high"])}

    got = _fold({"low": low, "high": high}, rounds, halve)
    u = (got["low"] + got["high"]) / 2
    return _times(p, F.when(r2 == 0, 1.0).otherwise(F.sqrt(u / r2) * scale))


def radial_normalised(p: Point, *ks: float) -> Point:
    """Radial, such that the radius 1 stays."""
    return _times(p, _polynomial(_r2(p), ks) / (1 + sum(ks)))


def brown(p: Point, k1: float, k2: float, k3: float, t1: float, t2: float) -> Point:
    """Radial and tangential terms."""
    x, y = p
    r2 = _r2(p)
    a, b = radial(p, k1, k2, k3)
    return a + t2 * (r2 + 2 * x * x) + 2 * t1 * x * y, b + t1 * (r2 + 2 * y * y) + 2 * t2 * x * y


def brown_removed(p: Point, k1: float, k2: float, k3: float, t1: float, t2: float, rounds: int = 11) -> Point:
    """Newton's steps with the two by two Jacobian, from p on."""

    def step(s):
        x, y = s["x"], s["y"]
        r2 = x * x + y * y
        f = _polynomial(r2, (k1, k2, k3))
        slope = k1 + r2 * (2 * k2) + r2 * r2 * (3 * k3)
        xx = f + 2 * x * x * slope + 6 * t2 * x + 2 * t1 * y
        xy = 2 * x * y * slope + 2 * t2 * y + 2 * t1 * x
        yy = f + 2 * y * y * slope + 6 * t1 * y + 2 * t2 * x
        u, v = brown((x, y), k1, k2, k3, t1, t2)
        u, v, d = u - p[0], v - p[1], xx * yy - xy * xy
        return {"x": x - (yy * u - xy * v) / d, "y": y - (xx * v - xy * u) / d}

    got = _fold({"x": p[0], "y": p[1]}, rounds, step)
    return got["x"], got["y"]


def fisheye(p: Point, *ks: float) -> Point:
    """A polynomial in the square of the ray's angle, times the angle."""
    r = F.sqrt(_r2(p))
    a = F.atan(r)
    return _times(p, F.when(r > 1e-8, a * _polynomial(a * a, ks) / r).otherwise(1.0))


def fisheye_removed(p: Point, *ks: float, rounds: int = 20) -> Point:
    far = F.sqrt(_r2(p))
    a = _fold({"a": far}, rounds, lambda s: {"a": far / _polynomial(s["a"] * s["a"], ks)})["a"]
    return _times(p, F.when(far > 1e-8, F.tan(a) / far).otherwise(1.0))


def fisheye_one(p: Point, k: float) -> Point:
    r = F.sqrt(_r2(p))
    return _times(p, F.when(k * r < 1e-8, 1.0).otherwise(F.atan(2 * r * tan(k / 2)) / (k * r)))


def fisheye_one_removed(p: Point, k: float) -> Point:
    r = F.sqrt(_r2(p))
    return _times(p, F.when(k * r < 1e-8, 1.0).otherwise(0.5 * F.tan(r * k) / (tan(k / 2) * r)))


# Models that take the distorted point to the plain one.


def classic_degrees(p: Point, c2: float, squeeze: float, cx: float, cy: float, c4: float) -> Point:
    """Degrees two and four with a squeeze along x and curvatures across."""
    x2, y2 = p[0] * p[0], p[1] * p[1]
    r4 = (x2 + y2) * (x2 + y2)
    return p[0] * (1 + (c2 * x2 + (c2 + cx) * y2 + c4 * r4) / squeeze), p[1] * (1 + (c2 + cy) * x2 + c2 * y2 + c4 * r4)


def radial_degrees(p: Point, c2: float, u2: float, v2: float, c4: float, u4: float, v4: float, phi: float, bend: float) -> Point:
    """Degrees two and four with decentring, then bent like a cylinder along phi."""
    x, y = p
    r2 = _r2(p)
    f, u, v = _polynomial(r2, (c2, c4)), u2 + r2 * u4, v2 + r2 * v4
    a = x * f + (r2 + 2 * x * x) * u + 2 * x * y * v
    b = y * f + (r2 + 2 * y * y) * v + 2 * x * y * u
    q = F.sqrt(F.lit(1.0 + bend))
    c, s = F.cos(F.lit(phi)), F.sin(F.lit(phi))
    across = (q - 1 / q) * c * s
    return (c * c * q + s * s / q) * a + across * b, across * a + (c * c / q + s * s * q) * b


def anamorphic_degrees(p: Point, cx: tuple[float, ...], cy: tuple[float, ...], phi: float, squeeze: tuple[float, float], aspect: float = 1.0) -> Point:
    """Degree four with terms in the double and fourfold angle (02, 22, 04, 24, 44), in axes turned by phi."""
    x, y = p[0] / aspect, p[1]
    c, s = F.cos(F.lit(phi)), F.sin(F.lit(phi))
    u, v = c * x - s * y, s * x + c * y
    r2 = u * u + v * v
    two = F.when(r2 == 0, 1.0).otherwise((u * u - v * v) / r2)  # cosine of the double angle
    four = 2 * two * two - 1
    f = lambda k: 1 + r2 * (k[0] + k[1] * two) + r2 * r2 * (k[2] + k[3] * two + k[4] * four)
    u, v = u * f(cx) * (aspect * squeeze[0]), v * f(cy) * squeeze[1]
    return c * u + s * v, c * v - s * u


ADD = {"none": lambda p: p, "radial1": radial, "radial3": radial, "radial3n": radial_normalised, "brown": brown, "fisheye4": fisheye, "fisheye1": fisheye_one}
REMOVE = {
    "none": lambda p: p, "radial1": radial_removed, "radial3": radial_removed, "radial3n": lambda p, *k: radial_removed(p, *k, scale=1 + sum(k)), "brown": brown_removed, "fisheye4": fisheye_removed, "fisheye1": fisheye_one_removed,
    "classic": classic_degrees, "degrees4": radial_degrees, "anamorphic": anamorphic_degrees, "radial3u": radial,
}


def add(p: Point, model: tuple) -> Point:
    return ADD[model[0]](p, *model[1:])


def remove(p: Point, model: tuple) -> Point:
    return REMOVE[model[0]](p, *model[1:])


# Whole cameras: scale, offset, size, model, and kind "pinhole" or "equidistant".


class Camera:
    def __init__(self, scale: tuple[float, float], offset: tuple[float, float], size: tuple[int, int], model: tuple = ("none",), kind: str = "pinhole", sensor: tuple[float, float] = (36.0, 24.0)):
        self.scale, self.offset, self.size, self.model, self.kind, self.sensor = scale, offset, size, model, kind, sensor

    def fov(self) -> float:
        """Radians that an equidistant image spans along its shorter side."""
        mm = self.scale[0] * self.sensor[0] / max(self.size)
        return min(self.sensor) / mm

    def _plane(self, x: L.Vec) -> Point:
        if self.kind == "pinhole":
            return x[0] / x[2], x[1] / x[2]
        angle, turn = F.atan2(F.sqrt(x[0] * x[0] + x[1] * x[1]), x[2]), F.atan2(x[1], x[0])
        r = angle / (0.5 * self.fov())
        return r * F.cos(turn), r * F.sin(turn)

    def project(self, x: L.Vec, r: L.Vec | None = None, c: L.Vec | None = None, distort: bool = True) -> Point:
        """Pixels of a point, of the world if a pose (rotation, centre) is given."""
        p = self._plane(L.pose_apply(r, c, x) if r is not None else x)
        return to_pixels(add(p, self.model) if distort else p, self.scale, self.offset, self.size)

    def undistorted(self, p: Point) -> Point:
        """The pixel where a pinhole without distortion would see it."""
        return to_pixels(remove(from_pixels(p, self.scale, self.offset, self.size), self.model), self.scale, self.offset, self.size)

    def ray(self, p: Point, undistort: bool = True) -> L.Vec:
        """The unit vector towards a pixel, before the camera."""
        q = from_pixels(p, self.scale, self.offset, self.size)
        q = remove(q, self.model) if undistort else q
        if self.kind == "pinhole":
            return L.unit((q[0], q[1], F.lit(1.0)))
        angle, turn = F.sqrt(_r2(q)) * (0.5 * self.fov()), F.atan2(q[1], q[0])
        return F.sin(angle) * F.cos(turn), F.sin(angle) * F.sin(turn), F.cos(angle)

    def world_ray(self, p: Point, r: L.Vec) -> L.Vec:
        """The unit vector towards a pixel, in the world."""
        return L.matvec(L.transpose(r, 3), self.ray(p))

    def backproject(self, p: Point, r: L.Vec, c: L.Vec, depth: Column, undistort: bool = True) -> L.Vec:
        """The world's point at `depth` along a pixel's ray (not along the camera's axis)."""
        return L.plus(L.matvec(L.transpose(r, 3), L.scaled(self.ray(p, undistort), depth)), c)

    def residual(self, x: L.Vec, seen: Point, r: L.Vec, c: L.Vec) -> Point:
        """Seen, without distortion, minus projected without distortion."""
        p, q = self.undistorted(seen), self.project(x, r, c, distort=False)
        return p[0] - q[0], p[1] - q[1]
