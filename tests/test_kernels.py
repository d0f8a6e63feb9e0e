import numpy as np
import pytest
from pyspark.sql import functions as F

from scenequery.functions import geometry as G
from scenequery.operators import kernels as K


def turn(*axis):
    v = np.array(axis, float)
    a = np.linalg.norm(v)
    x, y, z = v / a
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def scene(n=60, views=4, seed=1):
    rng = np.random.default_rng(seed)
    p = rng.uniform(-1, 1, (n, 3)) + [0, 0, 6]
    cams = np.array([np.column_stack([turn(0.01 + 0.1 * v, 0.05 * v, 0.02), [0.4 * v, -0.2 * v, 0.1 * v]]) for v in range(views)])
    h = G.ones(p) @ cams.transpose(0, 2, 1)
    return p, cams, h[:, :, :2] / h[:, :, 2:]


@pytest.mark.parametrize("fit, n", [(G.fundamental7, 7), (G.fundamental8, 20)])
def test_fundamental(fit, n):
    _, _, x = scene()
    assert min(G.epipolar_residuals(f, x[0], x[1]).max() for f in fit(x[0][:n], x[1][:n])) < 1e-12


def test_relative_pose():
    _, cams, x = scene()
    r, t, n = G.relative_pose(G.fundamental8(x[0], x[1])[0], x[0], x[1])
    true = cams[1][:, :3] @ cams[0][:, :3].T
    shift = cams[1][:, 3] - true @ cams[0][:, 3]
    assert n == 60 and np.allclose(r, true, atol=1e-6) and np.allclose(t, shift / np.linalg.norm(shift), atol=1e-6)


def test_rotation_averaging_with_an_outlier():
    true = np.array([turn(0.3 * k + 1e-3, 0.1 * k, -0.2 * k) for k in range(6)])
    true = true @ true[0].T
    edges = [(i, j) for i in range(6) for j in range(i + 1, 6)]
    rel = np.array([true[j] @ true[i].T for i, j in edges])
    rel[3] = turn(1, 2, 0) @ rel[3]
    assert np.allclose(G.average_rotations(6, edges, rel), true, atol=1e-2)


def test_rounds():
    assert G.rounds_needed(4, 0.01, 1.0) == 1 and G.rounds_needed(2, 0.01, 0.5) == 17


@pytest.mark.parametrize("kind", ["fundamental", "homography"])
def test_filter_matches(spark, kind):
    rng = np.random.default_rng(4)
    p, cams, x = scene()
    if kind == "homography":
        p[:, 2] = 6
        h = G.ones(p) @ cams.transpose(0, 2, 1)
        x = h[:, :, :2] / h[:, :, 2:]
    a, b = x[0] * 800 + 500, x[1] * 800 + 500
    b[40:] = rng.uniform(0, 1000, (20, 2))
    rows = [(1, 2, k, k, *map(float, a[k]), *map(float, b[k]), 1000, 1000) for k in range(60)]
    rows += [(1, 3, k, k, *map(float, rng.uniform(0, 1000, 4)), 1000, 1000) for k in range(60)] + [(1, 4, 0, 0, 1.0, 1.0, 1.0, 1.0, 9, 9)]
    m = spark.createDataFrame(rows, "i long, j long, fi long, fj long, xi double, yi double, xj double, yj double, width int, height int")
    got = K.filter_matches(m, kind, 400).collect()
    assert {(r.i, r.j) for r in got} == {(1, 2)}
    assert {r.fi for r in got} >= set(range(40)) and len(got) <= 44
    assert K.filter_matches(m.limit(0), kind).count() == 0


def test_triangulate_and_resect(spark):
    p, cams, x = scene()
    rows = [(k, v, *map(float, x[v][k]), cams[v].ravel().tolist(), *map(float, p[k])) for k in range(60) for v in range(4)]
    rows += [(99, 0, 0.1, 0.1, cams[0].ravel().tolist(), None, None, None), (98, 0, None, 0.0, cams[0].ravel().tolist(), None, None, None)]
    seen = spark.createDataFrame(rows, "track_id long, view_id long, x double, y double, camera array<double>, px double, py double, pz double")
    got = {r.track_id: r for r in K.triangulate_tracks(seen).collect()}
    assert sorted(got) == list(range(60))
    assert all(np.allclose(got[k].x, p[k], atol=1e-6) and got[k].n == 4 for k in got)
    back = {r.view_id: np.array(r.camera).reshape(3, 4) for r in K.resect_views(seen).collect()}
    assert all(np.allclose(back[v], cams[v], atol=1e-4) for v in range(4)) and len(back) == 4
    assert np.allclose(G.resect(p, x[1])[0], cams[1], atol=1e-6)
    twice = spark.createDataFrame([(1, 0.1, 0.1, cams[0].ravel().tolist())] * 2, "track_id long, x double, y double, camera array<double>")
    assert K.triangulate_tracks(twice).first().x is None


def test_align(spark):
    p, _, _ = scene()
    r, t = turn(0.2, -0.4, 0.9), np.array([1.0, -2, 3])
    q = 2.5 * p @ r.T + t
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(p, q)], "x array<double>, y array<double>")
    s, r2, t2 = K.align(df)
    assert abs(s - 2.5) < 1e-9 and np.allclose(r, r2) and np.allclose(t, t2)
    moved = K.transform(df, "x", s, r2, t2).select(F.max(F.abs(F.col("x")[0] - F.col("y")[0]))).first()[0]
    assert moved < 1e-9 and K.align(df.limit(2)) is None


def test_cycle_edges(spark):
    true = [turn(0.3 * k + 0.1, 0.1 * k, 0.2) for k in range(5)]
    e = [(i, j, (true[j] @ true[i].T).ravel().tolist()) for i, j in [(0, 1), (0, 2), (1, 2), (2, 3)]]
    e += [(1, 3, (turn(1, 0, 0) @ true[3] @ true[1].T).ravel().tolist())]
    got = K.cycle_edges(spark.createDataFrame(e, "i long, j long, r array<double>"), 2.0).collect()
    assert sorted((r.i, r.j) for r in got) == [(0, 1), (0, 2), (1, 2)]


def test_visual_words(spark):
    rng = np.random.default_rng(0)
    rows = [(k, (rng.normal(0, 0.01, 3) + 5 * (k % 3)).tolist()) for k in range(60)]
    got = K.visual_words(spark.createDataFrame(rows, "id long, d array<float>"), "d", 3, seed=1).collect()
    assert len({(r.id % 3, r.word) for r in got}) == 3
