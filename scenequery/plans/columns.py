"""Column functions as registered queries: numbers, vectors, lenses, poses, cameras, colours, metadata.

The numbers of embeddings, a to p, stand for coordinates; `e` below has them as columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scenequery.functions import colour, lenses, metadata
from scenequery.functions import linear as L
from scenequery.functions import scalars as S
from scenequery.plans.catalog import query, t

LETTERS = "abcdefghijkl"
E = "e AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {c}" for k, c in enumerate(LETTERS)) + " FROM embeddings)"


def _e(spark, d):
    x = t(spark, d, "embeddings")
    return x.select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(LETTERS)])


def _v(names: str):
    return tuple(F.col(c) for c in names)


def _staged(x, **parts):
    """x with the columns of named vectors, and these vectors by name: later expressions refer to them instead of holding them again."""
    x = x.withColumns({f"{n}_{k}": c for n, v in parts.items() for k, c in enumerate(v)})
    return x, {n: tuple(F.col(f"{n}_{k}") for k in range(len(v))) for n, v in parts.items()}


def _r(columns: dict, digits: int = 6):
    return [(F.round(c, digits) + 0.0).alias(n) for n, c in columns.items()]


def _rs(columns: dict, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0e0 AS {n}" for n, c in columns.items())


# Numbers.


@query("SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 5.0), 45.0) AS clamped, abs(l_discount - l_tax) < 1e-8 AS similar, CASE WHEN l_quantity - 25 < 0 THEN -1e0 ELSE 1e0 END AS side, CAST(ceil((l_quantity - 25) / 7) AS BIGINT) AS up, round(radians(l_quantity), 9) AS rad, round(degrees(l_discount), 9) AS deg FROM lineitem")
def number_functions(spark, d):
    q = F.col("l_quantity")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.clamp(q, 5.0, 45.0).alias("clamped"), S.is_similar(F.col("l_discount"), F.col("l_tax")).alias("similar"), S.sign(q - 25).alias("side"), S.divide_round_up(q - 25, F.lit(7)).alias("up"), F.round(F.radians(q), 9).alias("rad"), F.round(F.degrees("l_discount"), 9).alias("deg"))


@query("SELECT p_partkey, CAST(k * (p_size // 7) AS BIGINT) AS begin, CAST(CASE WHEN k = 6 THEN p_size ELSE (k + 1) * (p_size // 7) END AS BIGINT) AS end FROM part, generate_series(0, 6) g(k) WHERE p_size >= 7 UNION ALL SELECT p_partkey, 0, p_size FROM part WHERE p_size < 7")
def split_ranges(spark, d):
    x = t(spark, d, "part")
    return x.select("p_partkey", F.explode(S.split_range(F.lit(0), F.col("p_size"), 7)).alias("r")).select("p_partkey", "r.*")


_ZIP = "list_zip(embedding[1:32], embedding[33:64])"
_DIFF = f"list_transform({_ZIP}, lambda z: CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query(f"WITH x AS (SELECT vec_id, {_DIFF} AS diff, {_DOT.format('embedding[1:32]', 'embedding[33:64]')} AS pq, {_DOT.format('embedding[1:32]', 'embedding[1:32]')} AS pp, {_DOT.format('embedding[33:64]', 'embedding[33:64]')} AS qq FROM embeddings) SELECT vec_id, round(list_sum(list_transform(diff, lambda z: abs(z))), 6) AS l1, round(sqrt(list_sum(list_transform(diff, lambda z: z * z))), 6) AS l2, round(list_sum(list_transform(diff, lambda z: z * z)), 6) AS squared, round(list_max(list_transform(diff, lambda z: abs(z))), 6) AS most, round(pq / sqrt(pp * qq), 6) AS cosine FROM x")
def vector_distances(spark, d):
    v = F.col("embedding").cast("array<double>")
    a, b = F.slice(v, 1, 32), F.slice(v, 33, 32)
    cols = {"l1": S.distance_l1(a, b), "l2": S.distance_l2(a, b), "squared": S.squared_l2(a, b), "most": S.distance_max(a, b), "cosine": S.cosine(a, b)}
    return t(spark, d, "embeddings").select("vec_id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query("WITH h AS (SELECT l_orderkey, l_linenumber, CAST(bit_count(xor(l_partkey, l_suppkey)) + bit_count(xor(l_orderkey, l_partkey)) AS INTEGER) AS bits FROM lineitem) SELECT *, bits * bits AS squared FROM h")
def hamming_distances(spark, d):
    a, b = F.array("l_partkey", "l_orderkey"), F.array("l_suppkey", "l_partkey")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.hamming(a, b).alias("bits"), S.squared_hamming(a, b).alias("squared"))


@query("WITH r AS (SELECT c_custkey, c_acctbal / 1000 AS x, c_nationkey / 10e0 AS y, (c_custkey % 17) / 4e0 AS z FROM customer) SELECT c_custkey, k, round(CASE k WHEN 0 THEN least(x, y, z) WHEN 2 THEN greatest(x, y, z) ELSE x + y + z - least(x, y, z) - greatest(x, y, z) END, 5) + 0e0 AS root FROM r, generate_series(0, 2) g(k) WHERE abs(x - y) > 0.05 AND abs(x - z) > 0.05 AND abs(y - z) > 0.05")
def cubic_roots(spark, d):
    """The roots that a cubic was made from; rows with two nearly equal ones are left out, as rounding tells them apart."""
    x, y, z = F.col("c_acctbal") / 1000, F.col("c_nationkey") / 10, F.col("c_custkey") % 17 / 4
    far = (F.abs(x - y) > 0.05) & (F.abs(x - z) > 0.05) & (F.abs(y - z) > 0.05)
    roots = L.cubic_roots(-(x + y + z), x * y + x * z + y * z, -(x * y * z))
    return t(spark, d, "customer").filter(far).select("c_custkey", F.posexplode(roots).alias("k", "root")).select("c_custkey", F.col("k").cast("long").alias("k"), (F.round("root", 5) + 0.0).alias("root"))


# Vectors and boxes.

_AB, _BC = "(a * d + b * e + c * f)", "(d * d + e * e + f * f)"
_AA = "(a * a + b * b + c * c)"


@query(f"WITH {E} SELECT vec_id, " + _rs({"angle": f"degrees(acos(greatest(-1, least(1, {_AB} / sqrt({_AA} * {_BC})))))", "line": f"sqrt(greatest(0, {_AA} - {_AB} * {_AB} / {_BC}))", "plane": "abs((a - g) * d + (b - h) * e + (c - i) * f) / sqrt(d * d + e * e + f * f)", "volume": "abs(d - a) * abs(h - b) * abs(l - c)"}, 5) + ", a >= 0 AND b >= 0 AND a + b <= 1 AS inside FROM e")
def space_functions(spark, d):
    p, n, o = _v("abc"), _v("def"), _v("ghi")
    zero = (F.lit(0.0),) * 3
    corners = [p, (F.col("d"), F.col("b"), F.col("c")), p, (F.col("a"), F.col("h"), F.col("c")), (F.col("a"), F.col("b"), F.col("l"))]
    cols = {"angle": S.ray_angle(p, n), "line": S.point_line(p, zero, L.unit(n)), "plane": S.point_plane(p, o, n), "volume": S.box_volume(corners)}
    return _e(spark, d).select("vec_id", *_r(cols, 5), S.in_triangle(F.col("a"), F.col("b")).alias("inside"))


@query(f"WITH {E} SELECT vec_id, round(g, 5) + 0e0 AS u, round(h, 5) + 0e0 AS v FROM e WHERE abs(l) > 0.1")
def line_in_triangle(spark, d):
    """A line is sent through the point with barycentric coordinates g and h of the triangle (0, 0, l), (1, 0, l), (0, 1, l), and finds them."""
    o, i, z = F.lit(0.0), F.lit(1.0), F.col("l")
    a, b, c = (o, o, z), (o, i, z), (i, o, z)
    point = (F.col("g"), F.col("h"), z)
    way = (F.col("a"), F.col("b"), F.lit(2.0) + F.abs("c"))
    u, v = S.line_triangle(a, b, c, L.minus(point, L.scaled(way, 3.0)), way)
    return _e(spark, d).filter(F.abs("l") > 0.1).select("vec_id", *_r({"u": u, "v": v}, 5))


@query(f"WITH {E} SELECT vec_id, round(a, 4) + 0e0 AS x, round(b, 4) + 0e0 AS y, round(c, 4) + 0e0 AS z FROM e")
def midpoints(spark, d):
    """Two rays meet in the point that they were sent from."""
    p, c1, c2 = _v("abc"), (F.lit(-4.0), F.lit(0.5), F.lit(-3.0)), (F.lit(4.0), F.lit(-0.5), F.lit(-3.5))
    m = S.midpoint(c1, L.unit(L.minus(p, c1)), c2, L.unit(L.minus(p, c2)))
    return _e(spark, d).select("vec_id", *_r(dict(zip("xyz", m)), 4))


_RAY = ", ".join(f"CASE WHEN abs({q}) <= 1e-12 THEN -1e300 ELSE least((-1 - {p}) / {q}, (1 - {p}) / {q}) END AS n{k}, CASE WHEN abs({q}) <= 1e-12 THEN 1e300 ELSE greatest((-1 - {p}) / {q}, (1 - {p}) / {q}) END AS f{k}" for k, (p, q) in enumerate(zip("abc", "def")))


@query(f"WITH {E}, r AS (SELECT *, {_RAY} FROM e), s AS (SELECT *, greatest(n0, n1, n2) AS near, least(f0, f1, f2) AS far FROM r) SELECT vec_id, abs(a) <= 1 + 1e-12 AND abs(b) <= 1 + 1e-12 AND abs(c) <= 1 + 1e-12 AS inside, greatest(a, g) < least(a, g) + 1 AND greatest(b, h) < least(b, h) + 1 AND greatest(c, i) < least(c, i) + 1 AS overlap, round(greatest(a, g), 6) + 0e0 AS low_x, round(least(a, g) + 1, 6) + 0e0 AS high_x, near <= far AS hit, near < far AND far >= 0 AND far <= 1 AS leaves, round(CASE WHEN near <= far THEN near END, 4) + 0e0 AS near FROM s")
def box_functions(spark, d):
    low, high = (F.lit(-1.0),) * 3, (F.lit(1.0),) * 3
    p, way, q = _v("abc"), _v("def"), _v("ghi")
    one = (F.lit(1.0),) * 3
    overlap, lo, hi = S.box_overlap(p, L.plus(p, one), q, L.plus(q, one))
    hit, near, _ = S.ray_box(low, high, p, way)
    leaves = S.segment_box(low, high, p, L.plus(p, way))
    return _e(spark, d).select("vec_id", S.in_box(p, low, high).alias("inside"), overlap.alias("overlap"), *_r({"low_x": lo[0], "high_x": hi[0]}), hit.alias("hit"), leaves.alias("leaves"), (F.round(F.when(hit, near), 4) + 0.0).alias("near"))


@query(f"WITH {E}, q AS (SELECT *, d * d + e * e + f * f AS qa, a * d + b * e + c * f AS qb, a * a + b * b + c * c - 1 AS qc FROM e), s AS (SELECT *, CASE WHEN qb * qb - qa * qc >= 0 THEN (-qb - sqrt(qb * qb - qa * qc)) / qa END AS far FROM q) SELECT vec_id, " + _rs({"x": "a + far * d", "y": "b + far * e", "z": "c + far * f"}, 4) + " FROM s")
def sphere_hits(spark, d):
    hit = S.ray_sphere(_v("abc"), _v("def"))
    return _e(spark, d).select("vec_id", *_r(dict(zip("xyz", hit)), 4))


@query("SELECT o_orderkey, greatest(o_orderkey % 50, o_custkey % 60) AS begin, least(o_orderkey % 50 + 30, o_custkey % 60 + 25) AS end FROM orders")
def range_intersections(spark, d):
    a, b = F.col("o_orderkey") % 50, F.col("o_custkey") % 60
    begin, end = S.range_intersection(a, a + 30, b, b + 25)
    return t(spark, d, "orders").select("o_orderkey", begin.alias("begin"), end.alias("end"))


@query("WITH p AS (SELECT p_partkey, p_size * 37 % 2000 AS px, p_size * 13 % 1000 AS py FROM part), g AS (SELECT *, py / 1000.0 * pi() - pi() / 2 AS lat, px / 2000.0 * 2 * pi() - pi() AS lon FROM p) SELECT p_partkey, " + _rs({"x": "cos(lat) * sin(lon)", "y": "sin(lat)", "z": "cos(lat) * cos(lon)"}) + ", px + 0e0 AS back_x, py + 0e0 AS back_y FROM g WHERE py > 0 AND px > 0")
def sphere_pixels(spark, d):
    px, py = F.col("p_size") * 37 % 2000, F.col("p_size") * 13 % 1000
    v = S.from_equirectangular(px, py, 2000, 1000)
    bx, by = S.to_equirectangular(v, 2000, 1000)
    return t(spark, d, "part").filter((px > 0) & (py > 0)).select("p_partkey", *_r(dict(zip("xyz", v))), *_r({"back_x": bx, "back_y": by}, 3))


# Rotations, poses, cameras.

_A, _B, _C = "(vec_id % 7 * 0.2 - 0.5)", "(vec_id % 11 * 0.1 - 0.4)", "(vec_id % 13 * 0.15 - 0.9)"
ROT = f"q AS (SELECT *, cos({_A}) AS ca, sin({_A}) AS sa, cos({_B}) AS cb, sin({_B}) AS sb, cos({_C}) AS cc, sin({_C}) AS sc FROM e), r AS (SELECT *, cb * cc AS r0, -cb * sc AS r1, sb AS r2, ca * sc + sa * sb * cc AS r3, ca * cc - sa * sb * sc AS r4, -sa * cb AS r5, sa * sc - ca * sb * cc AS r6, sa * cc + ca * sb * sc AS r7, ca * cb AS r8 FROM q)"


def _rot():
    i = F.col("vec_id")
    return L.rotation_xyz(i % 7 * 0.2 - 0.5, i % 11 * 0.1 - 0.4, i % 13 * 0.15 - 0.9)


def _rx(p: str) -> list[str]:
    """SQL of the rotation's rows times a vector named by three letters."""
    return [f"(r{3 * k} * {p[0]} + r{3 * k + 1} * {p[1]} + r{3 * k + 2} * {p[2]})" for k in range(3)]


@query(f"WITH {E}, {ROT} SELECT vec_id, " + _rs({**{f"r{k}": f"r{k}" for k in range(9)}, "magnitude": "acos(greatest(-1, least(1, (r0 + r4 + r8) / 3)))", "angle": "acos(greatest(-1, least(1, (r0 + r4 + r8 - 1) / 2)))", "same": "acos(least(1, (r0 * r0 + r1 * r1 + r2 * r2 + r3 * r3 + r4 * r4 + r5 * r5 + r6 * r6 + r7 * r7 + r8 * r8) / 3 - 1e-16))"}, 5) + " FROM r")
def rotations(spark, d):
    r = _rot()
    cols = {**{f"r{k}": c for k, c in enumerate(r)}, "magnitude": L.rotation_magnitude(r), "angle": L.rotation_angle(r), "same": L.rotation_difference(r, r)}
    return _e(spark, d).select("vec_id", *_r(cols, 5))


@query(f"WITH {E} SELECT vec_id, " + _rs({"x": f"{_A} * 0.5", "y": "0.0", "z": "0.0", "k0": "0.0", "k1": "-c", "k2": "b", "k5": "-a"}, 6) + " FROM e")
def rotation_logs(spark, d):
    """The logarithm of a rotation about the first axis, and the matrix of a cross product."""
    i = F.col("vec_id")
    o = F.lit(0.0)
    log = L.rotation_log(L.rotation_xyz((i % 7 * 0.2 - 0.5) * 0.5, o, o))
    k = L.skew(_v("abc"))
    return _e(spark, d).select("vec_id", *_r({**dict(zip("xyz", log)), "k0": k[0], "k1": k[1], "k2": k[2], "k5": k[5]}))


@query(f"WITH {E}, {ROT} SELECT vec_id, " + _rs({"cx": "-(r0 * a + r3 * b + r6 * c)", "cy": "-(r1 * a + r4 * b + r7 * c)", "cz": "-(r2 * a + r5 * b + r8 * c)", "depth": "r6 * (g - d) + r7 * (h - e) + r8 * (i - f)", "ix": f"-{_rx('def')[0]}", "iy": f"-{_rx('def')[1]}", "iz": f"-{_rx('def')[2]}", "sx": "2 * e + 1", "sy": "-2 * d + 2", "sz": "2 * f + 3", "s0": "r1", "s1": "-r0", "s5": "r5"}, 5) + " FROM r")
def pose_functions(spark, d):
    """Centre from a translation, depth, inverse, and the pose after the world is turned by a quarter, doubled and moved."""
    r, tr, c, x = _rot(), _v("abc"), _v("def"), _v("ghi")
    o, i = F.lit(0.0), F.lit(1.0)
    quarter = (o, i, o, -i, o, o, o, o, i)
    _, inverse = L.pose_inverse(r, c)
    turned, moved = L.pose_similarity(r, c, 2.0, quarter, (F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    cols = {**dict(zip(("cx", "cy", "cz"), L.pose_centre(r, tr))), "depth": L.pose_depth(r, c, x), **dict(zip(("ix", "iy", "iz"), inverse)), **dict(zip(("sx", "sy", "sz"), moved)), "s0": turned[0], "s1": turned[1], "s5": turned[5]}
    return _e(spark, d).select("vec_id", *_r(cols, 5))


@query(f"WITH {E}, {ROT} SELECT vec_id, " + _rs({"s": "abs(j) + 0.5", **{f"r{k}": f"r{k}" for k in range(9)}, "x": "a", "y": "b", "z": "c"}, 5) + " FROM r")
def similarities(spark, d):
    """Scale, rotation and translation come back from the 4 x 4 matrix made of them."""
    s, r, tr = L.similarity_parts(L.similarity(F.abs("j") + 0.5, _rot(), _v("abc")))
    return _e(spark, d).select("vec_id", *_r({"s": s, **{f"r{k}": c for k, c in enumerate(r)}, **dict(zip("xyz", tr))}, 5))


_X = [f"({v} + t{k})" for k, v in enumerate(_rx("abc"))]


@query(f"WITH {E}, {ROT}, m AS (SELECT *, d AS t0, e AS t1, abs(f) + 6 AS t2 FROM r) SELECT vec_id, " + _rs({"px": f"900 * {_X[0]} / {_X[2]} + 500", "py": f"800 * {_X[1]} / {_X[2]} + 400", "depth": _X[2], "back": "a", "epipolar": "0.0"}, 4) + f", {_X[2]} >= 0 AS front FROM m")
def camera_matrices(spark, d):
    """Projection by K [R t], depth, homogeneous coordinates, and the fundamental matrix, whose epipolar residual of one point in two cameras is none."""
    o = F.lit(0.0)
    k = (F.lit(900.0), o, F.lit(500.0), o, F.lit(800.0), F.lit(400.0), o, o, F.lit(1.0))
    y, at = _staged(_e(spark, d), r=_rot(), t=(F.col("d"), F.col("e"), F.abs("f") + 6))
    x = _v("abc")
    y, ps = _staged(y, p=L.camera_matrix(k, at["r"], at["t"]), q=L.camera_matrix(k, L.rotation_xyz(o, F.lit(0.1), o), (F.lit(-1.0), o, F.lit(6.0))))
    y, seen = _staged(y, px=L.project(ps["p"], x), qx=L.project(ps["q"], x), f=L.fundamental(ps["p"], ps["q"]))
    px, qx, f = seen["px"], seen["qx"], seen["f"]
    left = L.dot(L.homogeneous(qx), L.matvec(f, L.homogeneous(px))) / L.norm(f)
    cols = {"px": px[0], "py": px[1], "depth": L.depth(at["r"], at["t"], x), "back": L.dehomogenised(L.homogeneous(x))[0], "epipolar": left}
    return y.select("vec_id", *_r(cols, 4), L.in_front(at["r"], at["t"], x).alias("front"))


@query(f"WITH {E}, s AS (SELECT *, sqrt(a * a + b * b + c * c) AS n, sqrt(a * a + c * c) AS m FROM e) SELECT vec_id, " + _rs({"x0": "c / m", "x1": "0.0", "x2": "-a / m", "y1": "m / n", "z0": "a / n", "z1": "b / n", "z2": "c / n"}, 5) + " FROM s")
def look_at_functions(spark, d):
    r = L.look_at(_v("abc"), (F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    return _e(spark, d).select("vec_id", *_r({"x0": r[0], "x1": r[1], "x2": r[2], "y1": r[4], "z0": r[6], "z1": r[7], "z2": r[8]}, 5))


@query(f"WITH {E}, p AS (SELECT 900 * a / (abs(c) + 4) - (900 * a / (abs(c) + 4) + d) AS dx, 900 * b / (abs(c) + 4) - (900 * b / (abs(c) + 4) + e) AS dy FROM e) SELECT round(sqrt(sum(dx * dx + dy * dy) / count(*)), 5) AS rmse FROM p")
def reprojection_rmse(spark, d):
    """Root of the mean squared distance between projected and seen points, by the number of points."""
    x = _e(spark, d)
    z = F.abs("c") + 4
    dx, dy = 900 * F.col("a") / z - (900 * F.col("a") / z + F.col("d")), 900 * F.col("b") / z - (900 * F.col("b") / z + F.col("e"))
    return x.agg(F.round(F.sqrt(F.sum(dx * dx + dy * dy) / F.count(F.lit(1))), 5).alias("rmse"))


# Lenses.

PLANE = "p AS (SELECT vec_id, a / (abs(c) + 3) AS x, b / (abs(c) + 3) AS y FROM e), q AS (SELECT *, x * x + y * y AS r2 FROM p)"


def _plane(spark, d):
    z = F.abs("c") + 3
    return _e(spark, d).select("vec_id", (F.col("a") / z).alias("x"), (F.col("b") / z).alias("y"))


MODELS = {"radial1": ("radial1", 0.1), "radial3": ("radial3", 0.1, 0.05, -0.001), "radial3n": ("radial3n", 0.1, 0.05, -0.001), "brown": ("brown", 0.05, 0.02, -0.001, 0.01, 0.02), "fisheye4": ("fisheye4", 0.1, 0.01, 0.001, 0.0001), "fisheye1": ("fisheye1", 0.8)}


@query(f"WITH {E}, {PLANE}, s AS (SELECT *, sqrt(r2) AS r FROM q), u AS (SELECT *, (1 + 0.1 * r2 + 0.05 * r2 * r2 - 0.001 * r2 * r2 * r2) / 1.149 AS n, CASE WHEN 0.8 * r < 1e-8 THEN 1 ELSE atan(2 * r * tan(0.4)) / (0.8 * r) END AS f FROM s) SELECT vec_id, " + _rs({"k1x": "x * (1 + 0.1 * r2)", "nx": "x * n", "ny": "y * n", "fx": "x * f", "fy": "y * f"}) + " FROM u")
def lens_add(spark, d):
    x = _plane(spark, d)
    p = (F.col("x"), F.col("y"))
    k, n, f = (lenses.add(p, MODELS[m]) for m in ("radial1", "radial3n", "fisheye1"))
    return x.select("vec_id", *_r({"k1x": k[0], "nx": n[0], "ny": n[1], "fx": f[0], "fy": f[1]}))


@query(f"WITH {E}, {PLANE} SELECT vec_id, " + _rs({f"{m}_{c}": c for m in MODELS for c in "xy"}, 4) + " FROM q")
def lens_remove(spark, d):
    """What each model adds, its inverse takes off."""
    x = _plane(spark, d)
    p = (F.col("x"), F.col("y"))
    back = {m: lenses.remove(lenses.add(p, model), model) for m, model in MODELS.items()}
    return x.select("vec_id", *_r({f"{m}_{c}": v for m, b in back.items() for c, v in zip("xy", b)}, 4))


_R4 = "(x * x + y * y) * (x * x + y * y)"
_P, _Q = "sqrt(1.2)", "1.0 / sqrt(1.2)"
_BX, _BY = "(x * (1 + 0.1 * r2 + 0.02 * r2 * r2) + (r2 + 2 * x * x) * (0.01 + 0.003 * r2) + 2 * x * y * (0.02 + 0.004 * r2))", "(y * (1 + 0.1 * r2 + 0.02 * r2 * r2) + (r2 + 2 * y * y) * (0.02 + 0.004 * r2) + 2 * x * y * (0.01 + 0.003 * r2))"
_AX = "(1 + 0.1 * r2 + 0.02 * (x * x - y * y) + 0.03 * r2 * r2 + 0.01 * r2 * (x * x - y * y) + 0.005 * (2 * (x * x - y * y) * (x * x - y * y) - r2 * r2))"


@query(f"WITH {E}, {PLANE} SELECT vec_id, " + _rs({"cx": f"x * (1 + (0.1 * x * x + 0.15 * y * y + 0.02 * {_R4}) / 1.1)", "cy": f"y * (1 + 0.13 * x * x + 0.1 * y * y + 0.02 * {_R4})", "dx": f"(cos(0.3) * cos(0.3) * {_P} + sin(0.3) * sin(0.3) * {_Q}) * {_BX} + ({_P} - {_Q}) * cos(0.3) * sin(0.3) * {_BY}", "dy": f"({_P} - {_Q}) * cos(0.3) * sin(0.3) * {_BX} + (cos(0.3) * cos(0.3) * {_Q} + sin(0.3) * sin(0.3) * {_P}) * {_BY}", "ax": f"x * {_AX} * 1.1", "ay": f"y * {_AX} * 0.9", "ux": "x * (1 + 0.1 * r2 + 0.05 * r2 * r2 - 0.001 * r2 * r2 * r2)"}) + " FROM q")
def lens_degrees(spark, d):
    """Models that are given from the distorted to the plain point."""
    x = _plane(spark, d)
    p = (F.col("x"), F.col("y"))
    k = (0.1, 0.02, 0.03, 0.01, 0.005)
    c, b = lenses.classic_degrees(p, 0.1, 1.1, 0.05, 0.03, 0.02), lenses.radial_degrees(p, 0.1, 0.01, 0.02, 0.02, 0.003, 0.004, 0.3, 0.2)
    a, u = lenses.anamorphic_degrees(p, k, k, 0.0, (1.1, 0.9)), lenses.remove(p, ("radial3u", 0.1, 0.05, -0.001))
    return x.select("vec_id", *_r({"cx": c[0], "cy": c[1], "dx": b[0], "dy": b[1], "ax": a[0], "ay": a[1], "ux": u[0]}))


CAMERAS = {"p": lenses.Camera((1000.0, 950.0), (10.0, -20.0), (1200, 900), ("radial3", 0.1, 0.05, -0.001)), "q": lenses.Camera((400.0, 400.0), (5.0, 3.0), (1000, 800), ("none",), "equidistant")}
_W = [f"(r{3 * k} * (a - d) + r{3 * k + 1} * (b - e) + r{3 * k + 2} * (c - f - 9))" for k in range(3)]


@query(f"WITH {E}, {ROT}, w AS (SELECT *, {_W[0]} AS wx, {_W[1]} AS wy, {_W[2]} AS wz FROM r), u AS (SELECT *, wx / wz AS x, wy / wz AS y, atan2(sqrt(wx * wx + wy * wy), wz) / (0.5 * 24 / (400 * 36.0 / 1000)) AS rr, atan2(wy, wx) AS tt FROM w WHERE abs(wz) > 0.5), v AS (SELECT *, 1 + 0.1 * (x * x + y * y) + 0.05 * (x * x + y * y) * (x * x + y * y) - 0.001 * (x * x + y * y) * (x * x + y * y) * (x * x + y * y) AS s FROM u WHERE x * x + y * y < 4) SELECT vec_id, " + _rs({"px": "1000 * x * s + 610", "py": "950 * y * s + 430", "qx": "400 * rr * cos(tt) + 505", "qy": "400 * rr * sin(tt) + 403", "plain_x": "1000 * x + 610"}, 3) + ", 1000 * x * s + 610 >= 0 AND 1000 * x * s + 610 < 1200 AND 950 * y * s + 430 >= 0 AND 950 * y * s + 430 < 900 AS visible, " + _rs({"rx": "0.0", "bx": "a", "by": "b", "bz": "c", "ex": "a", "cam_x": "x"}, 2) + " FROM v")
def whole_cameras(spark, d):
    """Projection with distortion by both kinds of camera, visibility, the pixel without distortion, residual, and points back from their pixels."""
    y, at = _staged(_e(spark, d), r=_rot(), c=(F.col("d"), F.col("e"), F.col("f") + 9))
    r, c, x = at["r"], at["c"], _v("abc")
    y, at = _staged(y, w=L.pose_apply(r, c, x))
    w = at["w"]
    u, v = w[0] / w[2], w[1] / w[2]
    y = y.filter((F.abs(w[2]) > 0.5) & (u * u + v * v < 4))
    y, at = _staged(y, p=CAMERAS["p"].project(x, r, c), q=CAMERAS["q"].project(x, r, c), far=(L.norm(w) * F.when(w[2] < 0, -1.0).otherwise(1.0),))
    p, q = at["p"], at["q"]
    y, got = _staged(y, plain=CAMERAS["p"].undistorted(p))
    plain = got["plain"]
    back, fish = CAMERAS["p"].backproject(p, r, c, at["far"][0]), CAMERAS["q"].backproject(q, r, c, L.norm(w))
    cols = {"px": p[0], "py": p[1], "qx": q[0], "qy": q[1], "plain_x": plain[0]}
    more = {"rx": CAMERAS["p"].residual(x, p, r, c)[0], "bx": back[0], "by": back[1], "bz": back[2], "ex": fish[0], "cam_x": lenses.from_pixels(plain, (1000.0, 950.0), (10.0, -20.0), (1200, 900))[0]}
    return y.select("vec_id", *_r(cols, 3), lenses.is_visible(p, (1200, 900)).alias("visible"), *_r(more, 2))


# Colours.

_XYZ = ["(0.4124 * r + 0.3576 * g + 0.1805 * b) * 0.9505", "(0.2126 * r + 0.7152 * g + 0.0722 * b)", "(0.0193 * r + 0.1192 * g + 0.9504 * b) * 1.0890"]
_LAB = ", ".join(f"CASE WHEN {v} > 0.008856 THEN cbrt({v}) ELSE {v} / 0.1284 + 0.1379 END AS f{k}" for k, v in enumerate(_XYZ))


@query(f"WITH c AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS r, l_tax * 10 AS g, l_quantity / 50 AS b FROM lineitem), f AS (SELECT *, {_LAB} FROM c) SELECT l_orderkey, l_linenumber, " + _rs({"gray": "0.299 * r + 0.587 * g + 0.114 * b", "linear": "0.2126 * r + 0.7152 * g + 0.0722 * b", "x": _XYZ[0], "z": _XYZ[2], "lab_l": "(116 * f1 - 16) / 100", "lab_a": "5 * (f0 - f1)", "lab_b": "2 * (f1 - f2)"}, 5) + f", round({_XYZ[1]}, 2) + 0e0 AS back_y FROM f")
def colour_functions(spark, d):
    rgb = (F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50)
    xyz = colour.rgb_to_xyz(rgb)
    lab = colour.rgb_to_lab(rgb)
    cols = {"gray": colour.gray(rgb), "linear": colour.gray_linear(rgb), "x": xyz[0], "z": xyz[2], "lab_l": lab[0], "lab_a": lab[1], "lab_b": lab[2]}
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_r(cols, 5), *_r({"back_y": colour.lab_to_xyz(lab)[1]}, 2))


@query("WITH c AS (SELECT p_partkey, p_size % 5 / 4.0 AS r, p_size % 7 / 6.0 AS g, p_size % 11 / 10.0 AS b FROM part), s AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM c), h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN (g - b) / d WHEN v = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END / 6 AS hue, CASE WHEN v = 0 THEN 0 ELSE d / v END AS sat FROM s), w AS (SELECT *, abs(hue - floor(hue) - 0.33) AS away FROM h) SELECT p_partkey, least(away, 1 - away) <= 0.2 AND sat BETWEEN 0.2 AND 1.0 AND v BETWEEN 0.1 AND 0.95 AS masked FROM w")
def hsv_mask(spark, d):
    rgb = tuple(F.col("p_size") % n / (n - 1) for n in (5, 7, 11))
    return t(spark, d, "part").select("p_partkey", colour.in_hsv_range(rgb, 0.33, 0.2, (0.2, 0.1), (1.0, 0.95)).alias("masked"))


@query("SELECT l_orderkey, l_linenumber, round(0.1 + 0.8 / (1 + exp(10 * (l_quantity - 25) / 20)), 7) AS falls, round(0.1 + 0.8 / (1 + exp(10 * (25 - l_quantity) / 20)), 7) AS rises, CASE l_linenumber WHEN 1 THEN 55e2 WHEN 2 THEN 415e1 WHEN 3 THEN 285e1 WHEN 4 THEN 55e2 ELSE 0e0 END AS kelvin FROM lineitem")
def light_functions(spark, d):
    q = F.col("l_quantity")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(colour.falling(0.1, 0.9, 20.0, 25.0, q), 7).alias("falls"), F.round(colour.rising(0.1, 0.9, 20.0, 25.0, q), 7).alias("rises"), colour.kelvin(F.col("l_linenumber")).alias("kelvin"))


# Metadata, names, text.


def _meta():
    """Entries under several spellings of their names."""
    key = F.col("p_partkey")
    taken = F.format_string("%04d:%02d:%02d %02d:%02d:%02d", 1990 + key % 30, key % 12 + 1, key % 28 + 1, key % 24, key % 60, key % 59)
    return F.map_filter(
        F.map_from_arrays(
            F.array(F.lit("Exif:FocalLength"), F.lit("EXIF/bodyserialnumber"), F.lit("DateTime"), F.lit("imageCounter"), F.lit("FocalLengthIn35mmFilm"), F.lit("GPS:Altitude")),
            F.array(F.concat((key % 90 + 10).cast("string"), F.when(key % 2 == 0, "/10").otherwise(" mm")), F.concat(F.lit("s"), (key % 5).cast("string")), taken, F.when(key % 3 == 0, "").otherwise((key % 100).cast("string")), F.when(key % 4 == 0, "x").otherwise("50"), F.lit("12")),
        ),
        lambda k, v: ~((k == "DateTime") & (key % 7 == 0)),
    )


@query("SELECT p_partkey, p_partkey % 7 <> 0 AS has_date, 's' || CAST(p_partkey % 5 AS VARCHAR) AS serial, CASE WHEN p_partkey % 2 = 0 THEN round((p_partkey % 90 + 10) / 10.0, 3) ELSE p_partkey % 90 + 10 END + 0e0 AS focal, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE CAST(p_partkey % 100 AS INTEGER) END AS counter, p_partkey % 4 <> 0 AS film, CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE (((((1990 + p_partkey % 30) * 12 + p_partkey % 12 + 1) * 31 + p_partkey % 28 + 1) * 24 + p_partkey % 24) * 60 + p_partkey % 60) * 60 + p_partkey % 59 END AS taken, CAST(NULL AS DOUBLE) AS gps FROM part")
def metadata_functions(spark, d):
    x = t(spark, d, "part").select("p_partkey", _meta().alias("meta"))
    m = F.col("meta")
    return x.select("p_partkey", metadata.has(m, ["DateTime"]).alias("has_date"), metadata.first(m, ["BodySerialNumber"]).alias("serial"), (F.round(metadata.focal_length(m), 3) + 0.0).alias("focal"), metadata.int_value(m, ["ImageCounter"]).alias("counter"), metadata.has_number(m, metadata.FOCAL35, True).alias("film"), metadata.taken(m).alias("taken"), metadata.position(m)[0].alias("gps"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN round(l_partkey / CAST(l_suppkey + 1 AS DOUBLE), 6) WHEN 2 THEN 0e0 WHEN 3 THEN l_quantity WHEN 4 THEN -1e0 ELSE -l_quantity END AS value FROM lineitem")
def real_numbers(spark, d):
    n = F.col("l_linenumber")
    text = F.when(n == 1, F.concat_ws("/", F.col("l_partkey").cast("string"), (F.col("l_suppkey") + 1).cast("string"))).when(n == 2, F.concat(F.lit("f "), F.col("l_partkey").cast("string"), F.lit("/0"))).when(n == 3, F.concat(F.col("l_quantity").cast("string"), F.lit(" mm"))).when(n == 4, F.lit("none")).otherwise(F.concat(F.lit(" -"), F.col("l_quantity").cast("string")))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(metadata.real_number(text), 6).alias("value"))


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * (c_custkey % 90 + c_nationkey / 60e0 + 195e-1 / 3600), 9) AS latitude, CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal ELSE c_acctbal END + 0e0 AS altitude FROM customer")
def gps_texts(spark, d):
    text = F.concat_ws(", ", (F.col("c_custkey") % 90).cast("string"), F.col("c_nationkey").cast("string"), F.lit("19.5"))
    lat = metadata.degrees(text, F.when(F.col("c_custkey") % 2 == 0, "N").otherwise("S"))
    alt = metadata.altitude(F.col("c_acctbal").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "1").otherwise("0"))
    return t(spark, d, "customer").select("c_custkey", F.round(lat, 9).alias("latitude"), (alt + 0.0).alias("altitude"))


@query("SELECT p_partkey, CASE WHEN p_size < 5 THEN NULL ELSE p_partkey END AS number, CASE WHEN p_size < 5 THEN '' WHEN p_size < 20 THEN '' ELSE 'img' || p_size || '_' END AS prefix, CASE WHEN p_size < 5 THEN '' WHEN p_size < 35 THEN '' ELSE '_left' END AS suffix, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, lower(regexp_replace(p_type || ' - ' || p_name, '[^A-Za-z0-9]', '', 'g')) AS reduced, CAST(len(p_name) - len(replace(p_name, ' ', '')) + 1 AS INTEGER) AS n_names FROM part")
def name_functions(spark, d):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    stem = F.when(size < 5, F.lit("cover_a")).when(size < 20, key).when(size < 35, F.concat(F.lit("img"), size.cast("string"), F.lit("_"), key)).otherwise(F.concat(F.lit("img"), size.cast("string"), F.lit("_"), key, F.lit("_left")))
    n, prefix, suffix = metadata.stem_number(stem)
    return t(spark, d, "part").select("p_partkey", n.alias("number"), prefix.alias("prefix"), suffix.alias("suffix"), metadata.zero_padded(size, 4).alias("padded"), metadata.reduced(F.concat_ws(" - ", "p_type", "p_name")).alias("reduced"), F.size(metadata.names(F.replace("p_name", F.lit(" "), F.lit(" , ,")))).alias("n_names"))


@query("WITH u AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder FROM pages) SELECT page_id, folder, name AS stem, '' AS extension, page_id AS id FROM u")
def path_functions(spark, d):
    """Folder, name and extension of a path; and ids that are given stay."""
    x = t(spark, d, "pages")
    u = F.regexp_replace("url", r"\.(?=[^/]*$)", "_")
    u = F.when(F.col("url").contains("."), u).otherwise(F.col("url"))
    none = F.create_map(F.lit("a"), F.lit("b"))
    given = metadata.incomplete_view_id(F.col("url"), none, F.lit("0"), F.col("page_id"))
    return x.select("page_id", metadata.folder_of(F.col("url")).alias("folder"), F.regexp_extract("url", "([^/]*)$", 1).alias("stem"), metadata.extension_of(u).alias("extension"), given.alias("id"))


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings")
def matrix_texts(spark, d):
    """Numbers written as a scene document holds them, and read back."""
    v = F.slice(F.col("embedding").cast("array<double>"), 1, 2)
    back = metadata.matrix_of(metadata.matrix_text(v))
    return t(spark, d, "embeddings").select("vec_id", back[0].alias("x"), back[1].alias("y"))


@query("SELECT p_partkey, regexp_matches(p_brand, 'Brand.[0-9]3') AS loose, p_partkey % 3 <> 0 AS filled, lpad(CAST(p_size AS VARCHAR), 5, '0') AS five, CASE WHEN p_size % 7 < p_size % 5 THEN '0' WHEN p_size % 5 < p_size % 7 THEN '1' ELSE '0' END AS first FROM part")
def small_functions(spark, d):
    s = F.col("p_size")
    meta = F.create_map(F.lit("k"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise("x"))
    order = S.arg_sort(F.array(s % 7, s % 5), 1)
    return t(spark, d, "part").select("p_partkey", F.col("p_brand").rlike(metadata.loose_glob("Brand?#3")).alias("loose"), metadata.has_value(meta, "k").alias("filled"), metadata.zero_padded(s, 5).alias("five"), order[0].cast("string").alias("first"))
