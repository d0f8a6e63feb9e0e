"""View frusta of pinhole cameras: corners, boxes, and the pairs that share some space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequery.functions import linear as L

#: Corners in the order near then far, each (left, top), (right, top), (right, bottom), (left, bottom); faces by three of their corners; edges by both ends.
FACES = [(0, 1, 2), (4, 5, 6), (0, 1, 5), (1, 2, 6), (2, 3, 7), (3, 0, 4)]
EDGES = [(0, 1), (1, 2), (0, 4), (1, 5), (2, 6), (3, 7)]


def frusta(views: DataFrame, horizon: float) -> DataFrame:
    """(view_id, corners: 24 numbers) of views(view_id, rotation: 9, center: 3, f, px, py, width, height, near, far).

    A null near begins at the camera's centre (a hair before it), a null far ends at the horizon; views without a pose or focal length have none.
    """
    r, c = L.entries(F.col("rotation"), 9), L.entries(F.col("center"), 3)
    depths = [F.coalesce("near", F.lit(horizon * 1e-9)), F.coalesce("far", F.lit(float(horizon)))]
    corners = []
    for z in depths:
        for u, v in ((F.lit(0.0), F.lit(0.0)), (F.col("width"), F.lit(0.0)), (F.col("width"), F.col("height")), (F.lit(0.0), F.col("height"))):
            ray = ((u - F.col("px")) / F.col("f"), (v - F.col("py")) / F.col("f"), F.lit(1.0))
            corners.extend(L.plus(L.matvec(L.transpose(r, 3), L.scaled(ray, z)), c))
    ok = views.filter((F.size("rotation") == 9) & (F.size("center") == 3) & (F.col("f") > 0))
    return ok.select("view_id", F.array(*corners).alias("corners"))


def _axes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Face normals and edge directions of frusta, (n, 8, 3) corners."""
    normals = np.stack([np.cross(p[:, b] - p[:, a], p[:, c] - p[:, a]) for a, b, c in FACES], 1)
    # a near face shrunk to a point has no normal of its own; the far face's serves
    normals[:, 0] = normals[:, 1]
    return normals, np.stack([p[:, b + 4 if a < 4 and b < 4 else b] - p[:, a + 4 if a < 4 and b < 4 else a] for a, b in EDGES], 1)


def meet(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether convex solids p[i] and q[i] share a point: no axis among the normals and the products of edges parts them."""
    (np_, ep), (nq, eq) = _axes(p), _axes(q)
    crosses = np.cross(ep[:, :, None], eq[:, None]).reshape(len(p), -1, 3)
    axes = np.concatenate([np_, nq, crosses], 1)
    size = np.linalg.norm(axes, axis=2, keepdims=True)
    axes = np.where(size > 1e-12 * np.maximum(size.max(1, keepdims=True), 1e-300), axes / np.maximum(size, 1e-300), 0)
    a, b = (np.einsum("nkd,ncd->nkc", axes, x) for x in (p, q))
    gap = np.maximum(a.min(2) - b.max(2), b.min(2) - a.max(2))
    return (gap <= 1e-9 * (1 + np.abs(a).max((1, 2)))[:, None]).all(1)


def _meeting(batches):
    for batch in batches:
        if batch.num_rows:
            p, q = (batch.column(c).flatten().to_numpy().reshape(-1, 8, 3) for c in ("p", "q"))
            yield batch.filter(pa.array(meet(p, q))).select(["i", "j"])


def pairs(solids: DataFrame) -> DataFrame:
    """(i, j), i < j, of frusta that share some space; those whose boxes meet along x, by cells of the mean width, and along y and z, are looked at."""
    at = lambda k: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get("corners", i * 3 + k))
    x = solids.withColumns({f"{n}{c}": f(at(k)) for k, c in enumerate("xyz") for n, f in (("low", F.array_min), ("high", F.array_max))})
    width = x.agg(F.avg(F.col("highx") - F.col("lowx"))).first()[0]
    if not width:
        width = 1.0
    cell = lambda c: F.floor(F.col(c) / width)
    x = x.withColumn("cell", F.explode(F.sequence(cell("lowx"), cell("highx"))))
    y = x.toDF(*[f"o{c}" for c in x.columns])
    both = x.join(y, (F.col("cell") == F.col("ocell")) & (F.col("view_id") < F.col("oview_id")))
    for c in "xyz":
        both = both.filter((F.col(f"low{c}") <= F.col(f"ohigh{c}")) & (F.col(f"olow{c}") <= F.col(f"high{c}")))
    both = both.filter(F.col("cell") == F.floor(F.greatest("lowx", "olowx") / width))
    return both.select(F.col("view_id").alias("i"), F.col("oview_id").alias("j"), F.col("corners").alias("p"), F.col("ocorners").alias("q")).mapInArrow(_meeting, "i long, j long")
