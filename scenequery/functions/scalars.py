"""Scalar columns: numbers, distances, plane geometry, ranges, tiles, spheres."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenequery.functions import linear as L

# Numbers.


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def is_similar(a: Column, b: Column, within: float = 1e-8) -> Column:
    return F.abs(a - b) < within


def sign(x: Column) -> Column:
    """-1 below 0, otherwise 1: 0 counts as positive."""
    return F.when(x < 0, -1.0).otherwise(1.0)


def divide_round_up(x: Column, y: Column) -> Column:
    """Whole division, rounded away from 0 where the quotient is positive and towards 0 where it is negative."""
    return F.ceil(x.cast("double") / y).cast("long")


def split_range(begin: Column, end: Column, parts: int) -> Column:
    """array<struct<begin, end>>: [begin, end) in `parts` equal pieces, the last with the rest; whole if shorter than `parts`."""
    size = F.floor((end - begin) / parts).cast("long")
    at = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
    piece = lambda b, e: F.struct(b.cast("long").alias("begin"), e.cast("long").alias("end"))
    many = F.transform(at, lambda k: piece(begin + k * size, F.when(k == parts - 1, end).otherwise(begin + (k + 1) * size)))
    return F.when(end - begin < parts, F.array(piece(begin, end))).otherwise(many)


# Distances between arrays of numbers.


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def distance_l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance_l2(a: Column, b: Column) -> Column:
    """Also the Frobenius distance of matrices given as arrays."""
    return F.sqrt(squared_l2(a, b))


def distance_max(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    both = lambda x, y: _sum(F.zip_with(x, y, lambda p, q: p * q))
    return both(a, b) / F.sqrt(both(a, a) * both(b, b))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of whole numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def squared_hamming(a: Column, b: Column) -> Column:
    h = hamming(a, b)
    return h * h


# Points, lines, planes, triangles; vectors as in `linear`.


def angle_between(a: L.Vec, b: L.Vec) -> Column:
    """Degrees, 0 where it isn't defined."""
    c = L.dot(L.unit(a), L.unit(b))
    return F.coalesce(F.when(F.abs(c) <= 1, F.degrees(F.acos(c))), F.lit(0.0))


def ray_angle(a: L.Vec, b: L.Vec) -> Column:
    """Degrees between rays, kept off 0 and 180 by 1e-8 in the cosine."""
    return F.degrees(F.acos(clamp(L.dot(a, b) / (L.norm(a) * L.norm(b)), -1 + 1e-8, 1 - 1e-8)))


def point_line(point: L.Vec, on_line: L.Vec, direction: L.Vec) -> Column:
    """Distance to a line with a unit direction."""
    return L.norm(L.cross(direction, L.minus(on_line, point)))


def point_plane(point: L.Vec, on_plane: L.Vec, normal: L.Vec) -> Column:
    return F.abs(L.dot(L.minus(point, on_plane), normal)) / L.norm(normal)


def in_triangle(u: Column, v: Column) -> Column:
    """By barycentric coordinates."""
    return (u >= 0) & (v >= 0) & (u + v <= 1)


def line_triangle(a: L.Vec, b: L.Vec, c: L.Vec, on_line: L.Vec, direction: L.Vec) -> tuple[Column, Column]:
    """Barycentric coordinates, along a to c and a to b, of where the line meets the triangle's plane."""
    e, f = L.minus(c, a), L.minus(b, a)
    # on_line + k direction = a + u e + v f, by Cramer's rule
    d = L.scaled(direction, -1)
    r = L.minus(on_line, a)
    columns = lambda x, y, z: L.determinant([x, y, z])
    whole = columns(d, e, f)
    return columns(d, r, f) / whole, columns(d, e, r) / whole


def box_volume(corners: list[L.Vec]) -> Column:
    """Volume of an upright box by its corners 0, 1 (along x), 3 (along y) and 4 (along z)."""
    return F.abs(corners[1][0] - corners[0][0]) * F.abs(corners[3][1] - corners[0][1]) * F.abs(corners[4][2] - corners[0][2])


def midpoint(c1: L.Vec, d1: L.Vec, c2: L.Vec, d2: L.Vec) -> L.Vec:
    """The point half-way between two lines where they are nearest; null for parallel lines."""
    w, a, b, c = L.minus(c1, c2), L.dot(d1, d1), L.dot(d1, d2), L.dot(d2, d2)
    d, e, whole = L.dot(d1, w), L.dot(d2, w), a * c - b * b
    s, t = (F.when(F.abs(whole) > 1e-12, x / whole) for x in (b * e - c * d, a * e - b * d))
    return L.scaled(L.plus(L.plus(c1, L.scaled(d1, s)), L.plus(c2, L.scaled(d2, t))), 0.5)


# Boxes (low, high: vectors) and rays.

TINY = 1e-12


def in_box(p: L.Vec, low: L.Vec, high: L.Vec) -> Column:
    return _all((x >= a - TINY) & (x <= b + TINY) for x, a, b in zip(p, low, high))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def box_overlap(low1: L.Vec, high1: L.Vec, low2: L.Vec, high2: L.Vec) -> tuple[Column, L.Vec, L.Vec]:
    """Whether two boxes share some space, and the box that they share."""
    low = tuple(F.greatest(a, b) for a, b in zip(low1, low2))
    high = tuple(F.least(a, b) for a, b in zip(high1, high2))
    return _all(a < b for a, b in zip(low, high)), low, high


def ray_box(low: L.Vec, high: L.Vec, start: L.Vec, direction: L.Vec) -> tuple[Column, Column, Column]:
    """Whether a line meets a box, and the least and greatest multiple of direction inside.  A direction without a part along an axis needs the start between the box's faces."""
    far = 1.7976931348623157e308
    ok, near, last = F.lit(True), F.lit(-far), F.lit(far)
    for a, b, s, d in zip(low, high, start, direction):
        flat = F.abs(d) <= TINY
        p, q = (a - s) / d, (b - s) / d
        ok = ok & (~flat | ((s >= a) & (s <= b)))
        near = F.when(flat, near).otherwise(F.greatest(near, F.least(p, q)))
        last = F.when(flat, last).otherwise(F.least(last, F.greatest(p, q)))
    return ok & (near <= last), near, last


def segment_box(low: L.Vec, high: L.Vec, start: L.Vec, end: L.Vec) -> Column:
    """Whether a segment leaves a box between its ends."""
    way = L.minus(end, start)
    size = L.norm(way)
    ok, near, last = ray_box(low, high, start, tuple(x / size for x in way))
    return F.when(size < TINY, False).otherwise(ok & (last >= 0) & (last <= size) & (near < last))


def ray_sphere(start: L.Vec, direction: L.Vec) -> L.Vec:
    """Where a line first meets the unit sphere; null where it doesn't."""
    a, b, c = L.dot(direction, direction), L.dot(direction, start), L.dot(start, start) - 1
    gap = b * b - a * c
    return L.plus(start, L.scaled(direction, F.when(gap >= 0, (-b - F.sqrt(gap)) / a)))


# Ranges, regions and tiles.


def range_intersection(begin1, end1, begin2, end2) -> tuple[Column, Column]:
    return F.greatest(begin1, begin2), F.least(end1, end2)


def one_tile(width: Column, height: Column, buffer_height: int) -> Column:
    """Whether an image fits one tile; both of its sides are held against the buffer's height."""
    return (width <= buffer_height) & (height <= buffer_height)


def tiles(width: Column, height: Column, buffer_width: int, buffer_height: int, padding: int, downscale: int = 1) -> Column:
    """array<struct<x_begin, x_end, y_begin, y_end>>: tiles column by column, each padded at its end only."""
    tile = lambda a, b, c, d: F.struct(*[v.cast("long").alias(n) for v, n in zip((a, b, c, d), ("x_begin", "x_end", "y_begin", "y_end"))])
    n = [divide_round_up(size, F.lit(b - 2 * padding)) for size, b in ((width, buffer_width), (height, buffer_height))]
    step = [divide_round_up(divide_round_up(size, F.lit(downscale)), k) * downscale for size, k in zip((width, height), n)]
    span = lambda k: F.sequence(F.lit(0).cast("long"), k - 1)
    end = lambda i, s, size: F.least((i + 1) * s + padding, size)
    many = F.flatten(F.transform(span(n[0]), lambda i: F.transform(span(n[1]), lambda j: tile(i * step[0], end(i, step[0], width), j * step[1], end(j, step[1], height)))))
    zero = F.lit(0)
    return F.when(one_tile(width, height, buffer_height), F.array(tile(zero, width, zero, height))).otherwise(many)


# Equirectangular images.


def from_equirectangular(x: Column, y: Column, width: int, height: int) -> L.Vec:
    lat, lon = y / height * pi - pi / 2, x / width * (2 * pi) - pi
    return F.cos(lat) * F.sin(lon), F.sin(lat), F.cos(lat) * F.cos(lon)


def to_equirectangular(v: L.Vec, width: int, height: int) -> tuple[Column, Column]:
    return (F.atan2(v[0], v[2]) + pi) / (2 * pi) * width, (F.asin(v[1]) + pi / 2) / pi * height


# Order within an array.


def arg_sort(values: Column, n: int | None = None) -> Column:
    """Places of the values in ascending order, of the n least if n is given; ties: the earlier place."""
    pairs = F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return F.transform(pairs if n is None else F.slice(pairs, 1, n), lambda p: p["i"])
