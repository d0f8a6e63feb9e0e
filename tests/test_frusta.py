import numpy as np
import pytest

from scenequery.operators import frusta as V

COLS = "view_id long, rotation array<double>, center array<double>, f double, px double, py double, width double, height double, near double, far double"


def looking(centre, at):
    z = np.array(at, float) - centre
    z /= np.linalg.norm(z)
    x = np.cross([0, 1, 0.01], z)
    x /= np.linalg.norm(x)
    return np.stack([x, np.cross(z, x), z])


def view(k, centre, at, near=None, far=None):
    return (k, looking(np.array(centre, float), at).ravel().tolist(), list(map(float, centre)), 1000.0, 500.0, 500.0, 1000.0, 1000.0, near, far)


@pytest.mark.parametrize("near, far", [(None, None), (0.1, 5.0), (0.1, None)])
def test_ring(spark, near, far):
    """Four cameras on a ring about a point all see one another's space; one that looks away from behind sees none of it."""
    views = [view(k, (2 * np.cos(k * np.pi / 2), 0, 2 * np.sin(k * np.pi / 2)), (0, 0, 0), near, far) for k in range(4)]
    views += [view(9, (0, 500, 0), (0, 900, 1), near, far), (10, None, [0.0, 0.0, 0.0], 1.0, 0.0, 0.0, 1.0, 1.0, near, far)]
    got = {tuple(r) for r in V.pairs(V.frusta(spark.createDataFrame(views, COLS), 100.0)).collect()}
    assert got == {(i, j) for i in range(4) for j in range(4) if i < j}


def test_against_points(spark):
    """Frusta that share one of many points meet; those that a plane between their corners parts do not."""
    r = np.random.default_rng(1)
    views = [view(k, r.normal(size=3) * 4, r.normal(size=3) * 4, 0.2, float(r.uniform(0.5, 6))) for k in range(40)]
    solids = V.frusta(spark.createDataFrame(views, COLS), 100.0)
    p = {x.view_id: np.array(x.corners).reshape(8, 3) for x in solids.collect()}
    got = {tuple(x) for x in V.pairs(solids).collect()}
    points = r.normal(size=(20000, 3)) * 5

    def inside(v):
        rot, c = np.array(v[1]).reshape(3, 3), np.array(v[2])
        q = (points - c) @ rot.T
        return (q[:, 2] >= v[8]) & (q[:, 2] <= v[9]) & (np.abs(q[:, :2] / q[:, 2:]) <= 0.5).all(1)

    hold = [inside(v) for v in views]
    for i in range(40):
        for j in range(i + 1, 40):
            if (hold[i] & hold[j]).any():
                assert (i, j) in got
            d = p[i].mean(0) - p[j].mean(0)
            if (p[i] @ d).min() > (p[j] @ d).max():
                assert (i, j) not in got
    assert V.pairs(solids.limit(0)).count() == 0
