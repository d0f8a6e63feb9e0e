"""Column math on small vectors, matrices, poses and camera matrices.

Vectors are tuples of columns; matrices are tuples of columns, row by row.
`entries` makes either from an array column, `packed` an array of them.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]


def entries(array: Column, n: int) -> Vec:
    return tuple(F.get(array, F.lit(k)) for k in range(n))


def packed(v: Vec) -> Column:
    return F.array(*v)


def total(terms) -> Column:
    terms = list(terms)
    out = terms[0]
    for x in terms[1:]:
        out = out + x
    return out


def dot(a: Vec, b: Vec) -> Column:
    return total(x * y for x, y in zip(a, b))


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Vec, s) -> Vec:
    return tuple(x * s for x in a)


def plus(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def unit(a: Vec) -> Vec:
    n = norm(a)
    return tuple(x / n for x in a)


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def matmul(a: Vec, b: Vec, inner: int) -> Vec:
    """The product of a, with `inner` columns, and b, with `inner` rows."""
    rows, columns = len(a) // inner, len(b) // inner
    return tuple(total(a[i * inner + k] * b[k * columns + j] for k in range(inner)) for i in range(rows) for j in range(columns))


def matvec(m: Vec, v: Vec) -> Vec:
    return matmul(m, v, len(v))


def transpose(m: Vec, columns: int) -> Vec:
    return tuple(m[i * columns + j] for j in range(columns) for i in range(len(m) // columns))


def determinant(rows: list[Vec]) -> Column:
    """By permutations; for at most four rows."""
    out = F.lit(0.0)
    for p in permutations(range(len(rows))):
        swaps = sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p)))
        term = F.lit(-1.0 if swaps % 2 else 1.0)
        for i, j in enumerate(p):
            term = term * rows[i][j]
        out = out + term
    return out


def skew(v: Vec) -> Vec:
    """The matrix that multiplies as v's cross product."""
    o = F.lit(0.0)
    return (o, -v[2], v[1], v[2], o, -v[0], -v[1], v[0], o)


# Rotations.


def rotation_xyz(x: Column, y: Column, z: Column) -> Vec:
    """About x, then y, then z, each about the moved axes."""
    o, i = F.lit(0.0), F.lit(1.0)
    rx = (i, o, o, o, F.cos(x), -F.sin(x), o, F.sin(x), F.cos(x))
    ry = (F.cos(y), o, F.sin(y), o, i, o, -F.sin(y), o, F.cos(y))
    rz = (F.cos(z), -F.sin(z), o, F.sin(z), F.cos(z), o, o, o, i)
    return matmul(matmul(rx, ry, 3), rz, 3)


def rotation_magnitude(r: Vec) -> Column:
    """acos(trace / 3): the measure that thresholds on rotation errors use; not the angle of the rotation."""
    return F.acos(F.least(F.greatest((r[0] + r[4] + r[8]) / 3, F.lit(-1.0)), F.lit(1.0)))


def rotation_angle(r: Vec) -> Column:
    """The angle that the rotation turns by."""
    return F.acos(F.least(F.greatest((r[0] + r[4] + r[8] - 1) / 2, F.lit(-1.0)), F.lit(1.0)))


def rotation_difference(a: Vec, b: Vec) -> Column:
    return rotation_magnitude(matmul(a, transpose(b, 3), 3))


def rotation_log(r: Vec) -> Vec:
    """Axis times angle; zero for the identity."""
    c = F.least(F.greatest((r[0] + r[4] + r[8] - 1) / 2, F.lit(-1.0)), F.lit(1.0))
    angle = F.acos(c)
    half = F.when(1 - c < 1e-24, F.lit(0.0)).otherwise(angle / (2 * F.sin(angle)))
    return (half * (r[7] - r[5]), half * (r[2] - r[6]), half * (r[3] - r[1]))


def look_at(centre: Vec, up: Vec) -> Vec:
    """Rows: across, upright and along the direction to centre."""
    z = unit(centre)
    x = unit(cross(up, z))
    return (*x, *cross(z, x), *z)


# Poses: rotation r (9) and centre c (3); a point X is seen at r (X - c).


def pose_centre(r: Vec, t: Vec) -> Vec:
    return scaled(matvec(transpose(r, 3), t), -1)


def pose_translation(r: Vec, c: Vec) -> Vec:
    return scaled(matvec(r, c), -1)


def pose_apply(r: Vec, c: Vec, x: Vec) -> Vec:
    return matvec(r, minus(x, c))


def pose_depth(r: Vec, c: Vec, x: Vec) -> Column:
    return pose_apply(r, c, x)[2]


def pose_inverse(r: Vec, c: Vec) -> tuple[Vec, Vec]:
    """The pose that undoes it."""
    return transpose(r, 3), pose_translation(r, c)


def pose_similarity(r: Vec, c: Vec, s, rotation: Vec, t: Vec) -> tuple[Vec, Vec]:
    """The pose after the world went through x -> s rotation x + t."""
    return matmul(r, transpose(rotation, 3), 3), plus(scaled(matvec(rotation, c), s), t)


def similarity(s, r: Vec, t: Vec) -> Vec:
    """The 4 x 4 matrix of x -> s r x + t."""
    o = F.lit(0.0)
    return (*scaled(r[0:3], s), t[0], *scaled(r[3:6], s), t[1], *scaled(r[6:9], s), t[2], o, o, o, F.lit(1.0))


def similarity_parts(m: Vec) -> tuple[Column, Vec, Vec]:
    """Scale, rotation and translation of a 4 x 4 similarity; nulls where it is none."""
    a = (*m[0:3], *m[4:7], *m[8:11])
    d = determinant([a[0:3], a[3:6], a[6:9]])
    s = F.when(d > 2.220446049250313e-16**3, F.cbrt(d))
    return s, tuple(x / s for x in a), tuple(F.when(s.isNotNull(), x) for x in (m[3], m[7], m[11]))


# Camera matrices: 12 numbers, row by row.


def camera_matrix(k: Vec, r: Vec, t: Vec) -> Vec:
    rt = (*r[0:3], t[0], *r[3:6], t[1], *r[6:9], t[2])
    return matmul(k, rt, 3)


def homogeneous(v: Vec) -> Vec:
    return (*v, F.lit(1.0))


def dehomogenised(v: Vec) -> Vec:
    return tuple(x / v[-1] for x in v[:-1])


def project(p: Vec, x: Vec) -> Vec:
    return dehomogenised(matvec(p, homogeneous(x)))


def depth(r: Vec, t: Vec, x: Vec) -> Column:
    return matvec(r, x)[2] + t[2]


def in_front(r: Vec, t: Vec, x: Vec) -> Column:
    return depth(r, t, x) >= 0


def fundamental(p: Vec, q: Vec) -> Vec:
    """F with x_q' F x_p = 0, from determinants of pairs of rows of both cameras."""
    rows = lambda m: [m[4 * i : 4 * i + 4] for i in range(3)]
    pick = lambda m: [[rows(m)[(i + 1) % 3], rows(m)[(i + 2) % 3]] for i in range(3)]
    return tuple(determinant([*a, *b]) for b in pick(q) for a in pick(p))


# Roots.


def cubic_roots(a: Column, b: Column, c: Column) -> Column:
    """The real roots of x^3 + a x^2 + b x + c, ascending; a double root stands twice."""
    q, r = (a * a - 3 * b) / 9, (2 * a * a * a - 9 * a * b + 27 * c) / 54
    gap = r * r - q * q * q
    angle = F.acos(F.least(F.greatest(r / F.sqrt(q * q * q), F.lit(-1.0)), F.lit(1.0)))
    three = F.array_sort(F.array(*[-2 * F.sqrt(q) * F.cos((angle + 2 * k * 3.141592653589793) / 3) - a / 3 for k in (-1, 0, 1)]))
    s = -F.when(r < 0, -1.0).otherwise(1.0) * F.cbrt(F.abs(r) + F.sqrt(F.greatest(gap, F.lit(0.0))))
    one = F.array(s + F.when(s == 0, 0.0).otherwise(q / s) - a / 3)
    return F.when((gap <= 0) & (q > 0), three).when((q == 0) & (r == 0), F.array(-a / 3, -a / 3, -a / 3)).otherwise(one)
