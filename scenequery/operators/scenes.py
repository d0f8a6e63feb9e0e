"""Filters over a scene's tables: observations, landmarks, poses, intrinsics, points.

observations: (landmark_id, view_id, ...); views: (view_id, pose_id, intrinsic_id, ...).
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequery.functions import scalars as S
from scenequery.operators import stats


def long_enough(observations: DataFrame, least: int, key: str = "landmark_id") -> DataFrame:
    """Observations of landmarks that have at least `least` of them."""
    return observations.join(stats.supported(observations, key, least), key, "left_semi")


def pixel_outliers(observations: DataFrame, residual: Column, depth: Column, most: float, least: int, scale: Column | None = None) -> DataFrame:
    """Observations before their camera with a residual (over a positive feature scale, if given) of at most `most`, of landmarks with at least `least` such."""
    r = residual if scale is None else F.when(scale > 0, residual / scale).otherwise(residual)
    return long_enough(observations.filter((depth >= 0) & (r <= most)), least)


def wide_angles(rays: DataFrame, least_degrees: float) -> DataFrame:
    """(landmark_id) of rays(landmark_id, x, y, z: unit vectors) with some pair of rays `least_degrees` or more apart.

    Most landmarks show it against their first ray; only those that don't are compared pair by pair, and
    there all rays lie in a narrow cone, which a grid of cells half an angle wide cuts further.
    """
    most_cos = F.cos(F.radians(F.lit(least_degrees)))
    v = rays.select("landmark_id", "x", "y", "z")
    first = v.groupBy("landmark_id").agg(F.min(F.struct("x", "y", "z")).alias("f"))
    x = v.join(first, "landmark_id")
    far = x.groupBy("landmark_id").agg(F.min(F.col("x") * F.col("f.x") + F.col("y") * F.col("f.y") + F.col("z") * F.col("f.z")).alias("c"))
    wide = far.filter(F.col("c") < most_cos).select("landmark_id")
    rest = v.join(wide, "landmark_id", "left_anti").distinct()
    other = rest.toDF("landmark_id", "p", "q", "r")
    pairs = rest.join(other, "landmark_id").filter(F.col("x") * F.col("p") + F.col("y") * F.col("q") + F.col("z") * F.col("r") < most_cos)
    return wide.union(pairs.select("landmark_id").distinct())


def angle_outliers(rays: DataFrame, least_degrees: float) -> DataFrame:
    """(landmark_id) of landmarks all of whose rays lie within `least_degrees` of one another."""
    return rays.select("landmark_id").distinct().join(wide_angles(rays, least_degrees), "landmark_id", "left_anti")


def unstable_poses(views: DataFrame, observations: DataFrame, least: int) -> DataFrame:
    """(pose_id, n) of poses whose views have fewer than `least` observations, none included."""
    n = observations.join(views.select("view_id", "pose_id"), "view_id").groupBy("pose_id").agg(F.count(F.lit(1)).alias("n"))
    return views.select("pose_id").distinct().join(n, "pose_id", "left").select("pose_id", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < least)


def without_poses(views: DataFrame, observations: DataFrame, gone: DataFrame, least: int) -> DataFrame:
    """Observations of views whose pose is left, of landmarks that still have `least` of them."""
    lost = views.join(gone.select("pose_id"), "pose_id", "left_semi").select("view_id")
    return long_enough(observations.join(lost, "view_id", "left_anti"), least)


def stable_scene(views: DataFrame, observations: DataFrame, least_per_pose: int, least_per_landmark: int) -> tuple[DataFrame, DataFrame]:
    """(views, observations) once poses with too few observations and landmarks with too few views are gone, in turn, until nothing goes."""
    views, observations = stats.cut(views), stats.cut(observations)
    n = None
    while True:
        gone = stats.cut(unstable_poses(views, observations, least_per_pose))
        observations = stats.cut(without_poses(views, observations, gone, least_per_landmark))
        views = stats.cut(views.join(gone.select("pose_id"), "pose_id", "left_anti"))
        left = (views.count(), observations.count())
        if left == n:
            return views, observations
        n = left


def valid_views(views: DataFrame, poses: DataFrame, intrinsics: DataFrame) -> DataFrame:
    """Views whose pose and intrinsic are there."""
    return views.join(poses.select("pose_id"), "pose_id", "left_semi").join(intrinsics.select("intrinsic_id"), "intrinsic_id", "left_semi")


def reconstructed_intrinsics(views: DataFrame, poses: DataFrame, intrinsics: DataFrame) -> DataFrame:
    """(intrinsic_id) with at least one valid view."""
    return valid_views(views, poses, intrinsics).select("intrinsic_id").distinct()


def referenced(rows: DataFrame, ends: list[str], keys: DataFrame) -> DataFrame:
    """Rows all of whose `ends` are among keys (one column)."""
    for end in ends:
        rows = rows.join(keys.toDF(end), end, "left_semi")
    return rows


def all_in_front(seen: DataFrame, depth: Column, key: str = "landmark_id") -> DataFrame:
    """(key) of landmarks that lie before each camera which sees them."""
    return seen.groupBy(key).agg(F.min(depth).alias("d")).filter(F.col("d") >= 0).select(key)


def tracks_to_triangulate(tracks: DataFrame, before: DataFrame, new: DataFrame, least: int) -> DataFrame:
    """(track, view): tracks of new views that at least `least` reconstructed views see, with those views; before(view), new(view)."""
    done = before.select("view").union(new.select("view")).distinct()
    mine = tracks.join(new.select("view"), "view", "left_semi").select("track").distinct()
    seen = tracks.select("track", "view").distinct().join(done, "view", "left_semi").join(mine, "track", "left_semi")
    return long_enough(seen, least, "track")


def observed_features(features: DataFrame, observations: DataFrame) -> DataFrame:
    """Features (view_id, feat_id, ...) that some landmark's observation refers to."""
    return features.join(observations.select("view_id", "feat_id").distinct(), ["view_id", "feat_id"], "left_semi")


def valid_points(points: DataFrame, size: str = "pix_size") -> DataFrame:
    return points.filter(F.col(size) != -1)


def rival_points(points: DataFrame, margin: float) -> DataFrame:
    """Points (id, x, y, z, pix_size, sim) that no better one crowds out.

    A point's radius is sqrt(margin * sim) * pix_size; points without one go, and so does a point that has
    another within its radius whose pix_size * sim is less (ties: the lesser id).  All points are
    judged on the whole input, so that the result does not depend on the order.  Cells as wide as
    a power of two above the radius keep the search to 27 cells of each point's own level.
    """
    r2 = F.lit(margin) * F.col("sim") * F.col("pix_size") * F.col("pix_size")
    ok = points.withColumn("r2", r2).filter((F.col("pix_size") != -1) & (F.col("r2") >= 2.220446049250313e-16))
    level = F.ceil(F.log2(F.sqrt("r2"))).cast("int")
    mine = ok.withColumn("level", level)
    levels = F.array(*[F.lit(r[0]) for r in mine.select("level").distinct().collect()], F.lit(None).cast("int"))  # binary exponents: a few thousand at most
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    there = ok.select(F.col("id").alias("other"), *[F.col(c).alias(f"o{c}") for c in "xyz"], (F.col("pix_size") * F.col("sim")).alias("oscore"), F.explode(levels).alias("level")).filter("level is not null")
    there = there.withColumns({f"c{c}": F.floor(F.col(f"o{c}") / F.pow(F.lit(2.0), F.col("level"))).cast("long") for c in "xyz"})
    near = mine.withColumn("score", F.col("pix_size") * F.col("sim"))
    for c in "xyz":
        near = near.withColumn(f"c{c}", F.explode(F.array(*[cell(c) + d for d in (-1, 0, 1)])))
    gap = sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in "yz"), (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")))
    better = (F.col("oscore") < F.col("score")) | ((F.col("oscore") == F.col("score")) & (F.col("other") < F.col("id")))
    lost = near.join(there, ["level", "cx", "cy", "cz"]).filter((F.col("id") != F.col("other")) & (gap < F.col("r2")) & better).select("id").distinct()
    return ok.drop("r2").join(lost, "id", "left_anti")


def small_triangles(triangles: DataFrame, ratio: float) -> DataFrame:
    """Triangles (ax..cz) none of whose edges is longer than ratio times the mean edge of all."""
    def edge(p, q):
        return F.sqrt(sum(((F.col(f"{p}{c}") - F.col(f"{q}{c}")) * (F.col(f"{p}{c}") - F.col(f"{q}{c}")) for c in "yz"), (F.col(f"{p}x") - F.col(f"{q}x")) * (F.col(f"{p}x") - F.col(f"{q}x"))))

    edges = [edge(*e) for e in ("ab", "bc", "ca")]
    mean = triangles.agg(F.avg((edges[0] + edges[1] + edges[2]) / 3)).first()[0]
    return triangles.filter(F.greatest(*edges) <= ratio * mean) if mean is not None else triangles


# Statistics of scenes.


def residual_histogram(residuals: DataFrame, value: str = "residual") -> tuple[DataFrame, DataFrame]:
    """Box statistics of residuals, and their histogram in bins of half a pixel up to the next whole pixel."""
    top = residuals.agg(F.max(value)).first()[0]
    end = ceil(top) if top else 1
    return stats.box(residuals, [], value), stats.histogram(residuals, F.col(value), 0, end, 2 * end)


def lengths(observations: DataFrame) -> DataFrame:
    """(landmark_id, length)."""
    return observations.groupBy("landmark_id").agg(F.count(F.lit(1)).alias("length"))


def lengths_per_view(observations: DataFrame) -> DataFrame:
    """Box statistics, per view, of the lengths of the landmarks that it sees."""
    return stats.box(observations.select("landmark_id", "view_id").join(lengths(observations), "landmark_id"), ["view_id"], "length")


def features_and_tracks(views: DataFrame, features: DataFrame, tracks: DataFrame) -> DataFrame:
    """(view, n_features, n_tracks) of all views(view), with zeros; features(view, ...), tracks(track, view, ...)."""
    f = features.groupBy("view").agg(F.count(F.lit(1)).alias("f"))
    t = tracks.select("track", "view").distinct().groupBy("view").agg(F.count(F.lit(1)).alias("t"))
    return views.select("view").join(f, "view", "left").join(t, "view", "left").select("view", F.coalesce("f", F.lit(0)).alias("n_features"), F.coalesce("t", F.lit(0)).alias("n_tracks"))


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{n}_{c}") for n, f in (("least", F.min), ("most", F.max)) for c in "xyz"])


def robust_box(points: DataFrame, share: float = 0.001, margin: float = 0.05) -> DataFrame:
    """Per axis, the values that a share of the points lies below and above, moved out by a margin of their distance; null where the box has no volume."""
    parts = None
    for c in "xyz":
        q = stats.order_statistics(points, [], c, {"low": share, "high": 1 - share}).select(F.col("low").alias(f"l{c}"), F.col("high").alias(f"h{c}"), F.lit(0).alias("k"))
        parts = q if parts is None else parts.join(q, "k")
    size = {c: F.col(f"h{c}") - F.col(f"l{c}") for c in "xyz"}
    fine = size["x"] * size["y"] * size["z"] >= 2.220446049250313e-16
    return parts.select(*[F.when(fine, F.col(f"l{c}") - size[c] * margin).alias(f"least_{c}") for c in "xyz"], *[F.when(fine, F.col(f"h{c}") + size[c] * margin).alias(f"most_{c}") for c in "xyz"])


def centres(points: DataFrame) -> DataFrame:
    """n, mean of each axis, and the sums of products of what is left when the means are taken off (not divided by n)."""
    names = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    s = points.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"v{a}{b}") for a, b in names])
    return s.select("n", "mean_x", "mean_y", "mean_z", *[(F.col(f"v{a}{b}") * F.col("n")).alias(f"scatter_{a}{b}") for a, b in names])


def median_exposure(exposures: DataFrame, column: str) -> DataFrame:
    """The upper median of the distinct exposures above 0."""
    x = exposures.select(F.col(column).alias("exposure")).filter("exposure > 0").distinct()
    return stats.order_statistics(x, [], "exposure", {"exposure": 0.5})


# Nearest cameras.


def plateau(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """0 up to a, rising to 1 at b, 1 up to c, falling to 0 at d."""
    return F.when((x > a) & (x <= b), (x - a) / (b - a)).when((x > b) & (x <= c), 1.0).when((x > c) & (x <= d), 1 - (x - c) / (d - c)).otherwise(0.0)


def view_pairs(rays: DataFrame) -> DataFrame:
    """(i, j, landmark_id, angle): the views of each landmark, ordered pairs, with the angle between their rays; rays(landmark_id, view_id, x, y, z)."""
    a = rays.select("landmark_id", F.col("view_id").alias("i"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = rays.select("landmark_id", F.col("view_id").alias("j"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    angle = S.ray_angle(tuple(F.col(f"a{c}") for c in "xyz"), tuple(F.col(f"b{c}") for c in "xyz"))
    return a.join(b, "landmark_id").filter("i != j").select("i", "j", "landmark_id", angle.alias("angle"))


def nearest_cameras(rays: DataFrame, k: int, low: float, high: float, least: int = 20) -> DataFrame:
    """(i, j, n, rank): for each view the k others that share most landmarks seen under an angle from low to high degrees, of those with more than `least`."""
    n = view_pairs(rays).filter(F.col("angle").between(low, high)).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    return stats.ranked(n, ["i"], [F.desc("n"), "j"], k)


def tile_cameras(rays: DataFrame, inside: DataFrame, k: int) -> DataFrame:
    """(i, tile, j, score, rank): for each tile of a view, the k others with the greatest sum of `plateau` over the angles of its landmarks; inside(view_id, landmark_id, tile)."""
    at = inside.select(F.col("view_id").alias("i"), "landmark_id", "tile")
    s = view_pairs(rays).join(at, ["i", "landmark_id"]).groupBy("i", "tile", "j").agg(F.sum(plateau(F.col("angle"), 1, 10, 50, 150)).alias("score"))
    return stats.ranked(s.filter("score > 0"), ["i", "tile"], [F.desc("score"), "j"], k)


def remapped(landmarks: DataFrame, tracks: DataFrame) -> DataFrame:
    """(track, landmark_id): tracks that hold a landmark's first observation, by the track's first such view; landmarks(landmark_id, view, feat), tracks(track, view, feat)."""
    first = landmarks.groupBy("landmark_id").agg(F.min(F.struct("view", "feat")).alias("f")).select("landmark_id", "f.view", "f.feat")
    first = first.groupBy("view", "feat").agg(F.min("landmark_id").alias("landmark_id"))
    return tracks.join(first, ["view", "feat"]).groupBy("track").agg(F.min(F.struct("view", "landmark_id")).alias("m")).select("track", "m.landmark_id")


def unique_markers(landmarks: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, marker, landmark_id): markers of the given kinds that only one landmark carries."""
    x = landmarks.filter(F.col("kind").isin(kinds)).groupBy("kind", "marker").agg(F.count(F.lit(1)).alias("n"), F.min("landmark_id").alias("landmark_id"))
    return x.filter("n = 1").drop("n")


def common_markers(a: DataFrame, b: DataFrame, kinds: list[str]) -> DataFrame:
    """(landmark_a, landmark_b) of markers unique in either scene."""
    one = lambda x, n: unique_markers(x, kinds).withColumnRenamed("landmark_id", n)
    return one(a, "landmark_a").join(one(b, "landmark_b"), ["kind", "marker"]).select("landmark_a", "landmark_b")


def common_views(a: DataFrame, b: DataFrame, key: str = "view_id") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def sanity_of_landmarks(observations: DataFrame, views: DataFrame) -> DataFrame:
    """Observations whose view is unknown: none, if the scene is sound."""
    return observations.join(views.select("view_id"), "view_id", "left_anti")


def rekeyed(views: DataFrame, observations: DataFrame, new_id: Column) -> tuple[DataFrame, DataFrame]:
    """Views with new ids, and observations that follow them."""
    ids = views.select("view_id", new_id.cast("long").alias("new_"))
    swap = lambda x: x.join(ids, "view_id").drop("view_id").withColumnRenamed("new_", "view_id").select(*x.columns)
    return swap(views), swap(observations)


def merged_by_landmarks(first: DataFrame, second: DataFrame, matches: DataFrame) -> DataFrame:
    """Observations of both scenes, those of matched landmarks under the first's id; the second's others get new ids behind the first's greatest; matches(landmark_a, landmark_b)."""
    top = first.agg(F.max("landmark_id").alias("top")).select(F.coalesce("top", F.lit(-1)).alias("top"))
    m = matches.groupBy(F.col("landmark_b").alias("landmark_id")).agg(F.min("landmark_a").alias("to_"))
    x = second.join(m, "landmark_id", "left").join(F.broadcast(top)).withColumn("landmark_id", F.coalesce("to_", F.col("landmark_id") + F.col("top") + 1)).drop("to_", "top")
    seen = first.select("landmark_id", "view_id")
    return first.unionByName(x.join(seen, ["landmark_id", "view_id"], "left_anti").select(*first.columns))


def hull_area(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, area) of the convex hull of each group's points.

    Of equal x only the least and greatest y can be corners, so that a task's part of a group shrinks before it
    meets the rest; what is gathered is a group's distinct x.
    """
    import numpy as np
    import pyarrow as pa

    ends = points.groupBy(*by, F.col(x).alias("x_")).agg(F.min(y).alias("low_"), F.max(y).alias("high_"))

    def area(key, t):
        t = t.sort_by("x_")
        px, low, high = (t.column(c).to_numpy() for c in ("x_", "low_", "high_"))
        total = 0.0
        for ys, side in ((low, 1), (high, -1)):
            chain: list[tuple[float, float]] = []
            for p in zip(px.tolist(), ys.tolist()):
                while len(chain) > 1 and side * ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) <= 0:
                    chain.pop()
                chain.append(p)
            c = np.array(chain)
            total -= side * float(((c[1:, 0] - c[:-1, 0]) * (c[1:, 1] + c[:-1, 1])).sum() / 2)
        return pa.table({**{n: pa.array([k.as_py()], k.type) for n, k in zip(by, key)}, "area": [abs(total)]})

    types = dict(points.dtypes)
    return ends.groupBy(*by).applyInArrow(area, ", ".join(f"{b} {types[b]}" for b in by) + ", area double")


def area_score(pairs: DataFrame, by: list[str], sizes: tuple[float, float]) -> DataFrame:
    """(by, score): how much of both images (their areas in sizes) the hulls of matched points (xi, yi, xj, yj) cover.

    Twice the first hull stands for both: a fixed quirk of the measure, whose thresholds were set with it.
    """
    return hull_area(pairs, by, "xi", "yi").select(*by, (F.col("area") * 2 / (sizes[0] + sizes[1])).alias("score"))
