"""Estimation over groups: geometric match filters, triangulation, resection, alignment, rotation cycles, visual words.

Least-squares kernels sum their normal matrices with Spark's own partial aggregation,
so that no group is gathered; only the small matrices reach NumPy, in Arrow batches.
Robust filters gather the matches of one pair, which its two views' features bound.
"""

from __future__ import annotations

import zlib
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequery.functions import geometry as G

#: kind: (sample, models of a sample, fit, residuals, dimension of what a point may miss)
MODELS = {
    "fundamental": (7, 3, G.fundamental7, G.epipolar_residuals, 1),
    "homography": (4, 1, G.homography, G.homography_residuals, 2),
}
STRONG = 2.5


def filter_matches(matches: DataFrame, kind: str, rounds: int = 1024) -> DataFrame:
    """(i, j, fi, fj, model, threshold): the matches of each pair that a model found a contrario keeps.

    matches(i, j, fi, fj, xi, yi, xj, yj, width, height); width and height are
    those of view j.  A pair without a meaningful model, or with no more than
    STRONG samples of inliers, gives no rows.  Draws are seeded by the pair.
    """
    sample, count, fit, residuals, dim = MODELS[kind]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna().sort_values(["fi", "fj", "xi", "yi", "xj", "yj"], ignore_index=True)
        x, y = g[["xi", "yi"]].to_numpy(float), g[["xj", "yj"]].to_numpy(float)
        found = None
        if len(g) > sample:
            w, h = float(g.width.iloc[0]), float(g.height.iloc[0])
            alpha = np.log10(np.pi / (w * h)) if dim == 2 else np.log10(2 * np.hypot(w, h) / (w * h))
            seed = zlib.crc32(f"{g.i.iloc[0]},{g.j.iloc[0]}".encode())
            found = G.a_contrario(len(g), sample, lambda k: fit(x[k], y[k]), lambda m: residuals(m, x, y), alpha, dim / 2, seed, rounds, count)
        keep = found[1] if found and len(found[1]) > STRONG * sample else np.array([], int)
        out = g.loc[keep, ["i", "j", "fi", "fj"]].copy()
        out["model"] = pd.Series([found[0].ravel().tolist()] * len(out) if len(out) else [], index=out.index, dtype=object)
        out["threshold"] = pd.Series(np.sqrt(found[2]) if len(out) else 0.0, index=out.index, dtype=float)
        return out

    columns = ["i", "j", "fi", "fj", "xi", "yi", "xj", "yj", "width", "height"]
    return matches.select(columns).groupBy("i", "j").applyInPandas(one, "i long, j long, fi long, fj long, model array<double>, threshold double")


def normal_matrix(rows: list[list[Column]], size: int) -> list[Column]:
    """Sums, over the group, of the upper triangle of a a' of all rows a."""
    return [F.sum(sum((a[p] * a[q] for a in rows[1:]), rows[0][p] * rows[0][q])).alias(f"m{k}") for k, (p, q) in enumerate(combinations_with_replacement(range(size), 2))]


def least_vectors(columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each matrix, given by its upper triangle, the eigenvector of the least eigenvalue, and all eigenvalues."""
    m = np.zeros((len(columns[0]), size, size))
    for v, (p, q) in zip(columns, combinations_with_replacement(range(size), 2)):
        m[:, p, q] = m[:, q, p] = v
    values, vectors = np.linalg.eigh(m)
    return vectors[:, :, 0], values


def triangulate_tracks(seen: DataFrame, least: int = 2) -> DataFrame:
    """(track_id, n, x: array of 3, null if the point is at infinity or not determined) of seen(track_id, x, y, camera: 12 doubles).

    Rows with a null take no part; tracks of fewer than `least` rows give none.
    """
    c = lambda k: F.col("camera")[k]
    rows = []
    for n, at in enumerate(("x", "y")):
        a = [F.col(at) * c(8 + k) - c(4 * n + k) for k in range(4)]
        norm = F.sqrt(sum((x * x for x in a[1:]), a[0] * a[0]))
        rows.append([x / norm for x in a])
    ok = seen.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.size("camera") == 12))
    sums = ok.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), *normal_matrix(rows, 4)).filter(F.col("n") >= least)

    def solve(batches):
        for b in batches:
            if b.num_rows:
                p, values = least_vectors([b.column(f"m{k}").to_numpy(zero_copy_only=False) for k in range(10)], 4)
                fine = (np.abs(p[:, 3]) > 1e-12) & (values[:, 1] > 1e-12)
                x = p[:, :3] / np.where(fine, p[:, 3], 1)[:, None]
                yield pa.record_batch([b.column("track_id"), b.column("n"), pa.array([list(v) if ok else None for v, ok in zip(x, fine)], pa.list_(pa.float64()))], ["track_id", "n", "x"])

    return sums.mapInArrow(solve, "track_id long, n long, x array<double>")


def resect_views(seen: DataFrame, least: int = 6) -> DataFrame:
    """(view_id, n, camera: 12 doubles, null if not determined) of seen(view_id, x, y, px, py, pz), by linear least squares.

    The camera's third row has norm one and points with positive depth before it; image
    coordinates should be of the order of one (rays), as nothing is rescaled.
    """
    p, o = [F.col("px"), F.col("py"), F.col("pz"), F.lit(1.0)], [F.lit(0.0)] * 4
    rows = [[*p, *o, *(-F.col("x") * v for v in p)], [*o, *p, *(-F.col("y") * v for v in p)]]
    sums = seen.dropna(subset=["x", "y", "px", "py", "pz"]).groupBy("view_id").agg(F.count(F.lit(1)).alias("n"), *normal_matrix(rows, 12)).filter(F.col("n") >= least)

    def solve(batches):
        for b in batches:
            if b.num_rows:
                v, values = least_vectors([b.column(f"m{k}").to_numpy(zero_copy_only=False) for k in range(78)], 12)
                m = v.reshape(-1, 3, 4)
                m = m * (np.sign(np.linalg.det(m[:, :, :3])) / np.maximum(np.linalg.norm(m[:, 2, :3], axis=1), 1e-12))[:, None, None]
                fine = values[:, 1] > 1e-9 * values[:, -1]
                yield pa.record_batch([b.column("view_id"), b.column("n"), pa.array([x.ravel().tolist() if ok else None for x, ok in zip(m, fine)], pa.list_(pa.float64()))], ["view_id", "n", "camera"])

    return sums.mapInArrow(solve, "view_id long, n long, camera array<double>")


def align(pairs: DataFrame) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(scale, R, t) that best takes x to y of pairs(x, y), arrays of 3; None of fewer than 3 pairs.  One row of sums reaches the driver."""
    x, y = ([F.col(c)[k] for k in range(3)] for c in "xy")
    sums = [F.count(F.lit(1)), *map(F.sum, x), *map(F.sum, y), F.sum(sum((v * v for v in x[1:]), x[0] * x[0])), *(F.sum(b * a) for b in y for a in x)]
    v = pairs.filter((F.size("x") == 3) & (F.size("y") == 3)).agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
    return G.similarity(v[0], np.array(v[1:4]), np.array(v[4:7]), v[7], np.array(v[8:]).reshape(3, 3)) if v[0] >= 3 else None


def transform(points: DataFrame, column: str, scale: float, r: np.ndarray, t: np.ndarray) -> DataFrame:
    """`column` (array of 3) becomes scale R x + t."""
    c = F.col(column)
    return points.withColumn(column, F.array(*[sum((float(scale * r[a, b]) * c[b] for b in range(3)), F.lit(float(t[a]))) for a in range(3)]))


def cycle_edges(edges: DataFrame, degrees: float) -> DataFrame:
    """Those of edges(i, j, r), i < j and r an array of 9, in a triangle whose rotations come back within `degrees`, by acos(trace / 3)."""
    e = edges.select("i", "j", "r")
    tri = e.select("i", "j", F.col("r").alias("a")).join(e.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("r").alias("b")), "j")
    tri = tri.join(e.select("i", F.col("j").alias("k"), F.col("r").alias("c")), ["i", "k"])
    # trace of R_ik' R_jk R_ij
    trace = sum((F.col("b")[3 * p + q] * F.col("a")[3 * q + s] * F.col("c")[3 * p + s] for p in range(3) for q in range(3) for s in range(3)), F.lit(0.0))
    good = tri.filter(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), trace / 3)))) < degrees)
    kept = good.select(F.explode(F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for a, b in ("ij", "jk", "ik")])).alias("e")).select("e.i", "e.j").distinct()
    return edges.join(kept, ["i", "j"], "left_semi")


def visual_words(features: DataFrame, column: str, k: int, seed: int = 0, rounds: int = 20) -> DataFrame:
    """features with `word`, the nearest of k centres fitted to all of them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = features.withColumn("_vector", array_to_vector(F.col(column).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_vector", predictionCol="word").fit(x)
    return model.transform(x).drop("_vector")
