"""Operators whose queries have no SQL, and odd input, against brute force."""

import math
import random

import numpy as np
import pytest

from scenequery.functions import linear as L
from scenequery.functions import metadata
from scenequery.functions import scalars as S
from scenequery.operators import matching, pairs, retrieval, scenes, stats, views

F = views.F


def test_spread_matches(spark):
    r = random.Random(1)
    rows = [(0, 1, "a", k, k + 1, r.random() * 120, r.random() * 90, float(r.randrange(4)), r.random() * 120, r.random() * 90, float(r.randrange(4)), 100, 80, 100, 80) for k in range(60)]
    cols = "i long, j long, kind string, fi long, fj long, xi double, yi double, si double, xj double, yj double, sj double, wi int, hi int, wj int, hj int"
    got = [(x.fi, x.rank) for x in matching.spread(spark.createDataFrame(rows, cols), 25).collect()]
    cells = {}
    cell = lambda x, y: int(min(max(x // 34 + y // 27 * 3, 0), 2))
    for m in sorted(rows, key=lambda m: (-(m[7] + m[10]) / 2, m[3], m[4])):
        a, b = cells.setdefault((0, cell(m[5], m[6])), []), cells.setdefault((1, cell(m[8], m[9])), [])
        (a if len(a) <= len(b) else b).append(m[3])
    want = [c[k] for k in range(60) for _, c in sorted(cells.items()) if k < len(c)][:25]
    assert sorted(got, key=lambda x: x[1]) == [(f, k + 1) for k, f in enumerate(want)]


def test_cascaded_hashes_find_near_rows(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 32))
    x[1::2] = x[::2] + r.normal(size=(300, 32)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = matching.knn_hashed(df.filter("id % 20 = 0"), df, 2).filter("i != j").select("i", "j").collect()
    assert sum(m.j == m.i + 1 for m in got) >= 0.9 * 30
    assert matching.knn_hashed(df.limit(0), df, 2).count() == 0 and matching.matcher("brute_force") is matching.knn
    with pytest.raises(ValueError):
        matching.matcher("none")


def test_epipolar_guide(spark):
    r = random.Random(3)
    f = [0.0, 0.0004, -0.2, -0.0003, 0.0, 0.15, 0.18, -0.12, 3.0]
    left, right = ([(k, r.random() * 400, r.random() * 300) for k in range(80)] for _ in range(2))
    want = {}
    for i, x, y in left:
        a, b, c = (f[3 * k] * x + f[3 * k + 1] * y + f[3 * k + 2] for k in range(3))
        best = min((abs(a * u + b * v + c) / math.hypot(a, b), j) for j, u, v in right)
        if best[0] < 2:
            want[i] = best[1]
    df = [spark.createDataFrame(p, "id long, x double, y double") for p in (left, right)]
    assert {m.i: m.j for m in matching.guided_epipolar(*df, f, 2.0, (400, 300)).collect()} == want and len(want) > 20


def test_best_images(spark):
    r = random.Random(4)
    points = [(i, r.choice([r.randrange(9), i % 3])) for i in range(8) for _ in range(12)]
    df = spark.createDataFrame(points, "image long, cell long")
    taken, left = [], list(range(8))
    while len(taken) < 4:
        by = taken or left
        weight = {c: sum(any(p == (i, c) for p in points) for i in by) for c in range(9)}
        score = {i: sum(weight[c] for k, c in points if k == i) / sum(k == i for k, _ in points) for i in left}
        best = min(left, key=lambda i: (score[i], i))
        taken.append(best)
        left.remove(best)
    assert [r.image for r in sorted(views.best_images(df, 4, 3).collect(), key=lambda r: r.rank)] == taken
    assert views.best_images(df, 9, 3).count() == 8


def test_steps_and_targets():
    assert [views.frame_step(100, 2), views.frame_step(100, 2, 8), views.frame_step(100, 2, 8, 10), views.frame_step(100, 2, 20, 10), views.frame_step(5, 0)] == [2, 5, 8, 11, 1]
    assert views.target_index(5, 0) == 2 and views.target_index(4, -1) == 1 and views.target_index(3, 9, [0.1, 0.4, 0.9, 0.8]) == 1
    with pytest.raises(ValueError):
        views.target_index(3, 9)
    assert views.pyramid_weights(3) == [4, 2, 1] and views.pyramid_threshold(2) == 0.2 * (2 * 4 + 16)
    assert stats.bin_values(0, 1, 3) == [0, 0.5, 1]


def test_divide_and_gps_fixtures(spark):
    x = spark.createDataFrame([(3, 2), (1001, 1000), (-3, 2), (3, -2), (-1, -2)], "x long, y long")
    assert [r[0] for r in x.select(S.divide_round_up(F.col("x"), F.col("y"))).collect()] == [2, 2, -1, -1, 1]
    one = spark.range(1)
    got = one.select(metadata.degrees(F.lit("1, 27, 19.0008"), F.lit("E")), metadata.altitude(F.lit("10785.65"), F.lit("1"))).first()
    assert got[0] == pytest.approx(1.45527799, abs=1e-6) and got[1] == -10785.65
    for bad in (metadata.degrees(F.lit("1"), F.lit("G")), metadata.altitude(F.lit("1"), F.lit("N"))):
        with pytest.raises(Exception, match="unexpected reference"):
            one.select(bad).collect()


def test_order_statistics(spark):
    r = random.Random(5)
    rows = [(g, float(r.choice([r.randrange(5), r.gauss(0, 9)]))) for g in range(3) for _ in range([1, 2, 2000][g])] + [(0, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    for x in stats.order_statistics(df, ["g"], "v", shares).collect():
        v = sorted(v for g, v in rows if g == x.g and v is not None)
        assert [x[n] for n in shares] == [v[min(len(v) - 1, int(len(v) * s))] for s in shares.values()]
    assert {x.g: x.median for x in stats.median(df, ["g"], "v").collect()} == {g: pytest.approx(float(np.median([v for k, v in rows if k == g and v is not None]))) for g in range(3)}
    assert stats.order_statistics(df.limit(0), [], "v", {"a": 0.5}).count() == 0


def test_angles_of_many_rays(spark):
    r = np.random.default_rng(6)
    rays, want = [], set()
    for k in range(40):
        base = r.normal(size=3)
        v = base + r.normal(size=(r.integers(1, 9), 3)) * 0.06
        v /= np.linalg.norm(v, axis=1)[:, None]
        rays += [(k, *map(float, p)) for p in v]
        if (v @ v.T).min() < math.cos(math.radians(6)):
            want.add(k)
    df = spark.createDataFrame(rays, "landmark_id long, x double, y double, z double")
    assert {x[0] for x in scenes.wide_angles(df, 6.0).collect()} == want and 0 < len(want) < 40


def test_classic_retrieval_and_pairs(spark):
    r = random.Random(7)
    docs = {d: [r.randrange(40) for _ in range(r.randint(1, 25))] for d in range(30)}
    tf = retrieval.term_counts(spark.createDataFrame([(d, w) for d, ws in docs.items() for w in ws], "doc long, word long"))
    got = {}
    for x in retrieval.self_check(tf, 3).collect():
        got.setdefault(x["query"], []).append((x["rank"], x["distance"], x["doc"]))
    from collections import Counter
    c = {d: Counter(ws) for d, ws in docs.items()}
    dist = lambda a, b: sum(abs(c[a][w] - c[b][w]) for w in c[a] | c[b])
    for q in docs:
        assert [(d, e) for _, d, e in sorted(got[q])] == sorted((dist(q, e), e) for e in docs)[:3]
    x = spark.createDataFrame([(0, 1, 1), (1, 0, 1), (2, 0, 1), (3, 9, 1), (9, 3, 1)], "query long, doc long, rank int")
    assert sorted(map(tuple, pairs.pair_list(x, 0).collect())) == [(0, 1), (2, 0), (3, 9)]
    assert pairs.method("frustum_or_retrieval", 10, 10, True, 3) == "frustum" and pairs.method("retrieval", 2, 0, True, 3) == "exhaustive"
    assert len(pairs.sides(x, x, "a/b")) == 1
    with pytest.raises(ValueError):
        pairs.sides(x, x, "b")


def test_lens_and_cubic_edges(spark):
    x = spark.createDataFrame([(0.0, 0.0, 0.0), (-3.0, 3.0, -1.0), (0.0, 0.0, -8.0)], "a double, b double, c double")
    got = [r[0] for r in x.select(L.cubic_roots(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got[0][0] == 0 and got[1] == pytest.approx([1, 1, 1]) and got[2] == pytest.approx([2])


def test_hull_areas(spark):
    r = random.Random(8)
    rows = [(g, float(r.randrange(30)), float(r.randrange(30))) for g in range(6) for _ in range([1, 2, 3, 40, 40, 300][g])]
    got = {x.g: x.area for x in scenes.hull_area(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y").collect()}
    for g in range(6):
        p = sorted({(x, y) for k, x, y in rows if k == g})
        # a pair of points is an edge of the hull if no point is left of it; the shoelace over all edges
        area = 0.0
        for a in p:
            for b in p:
                if a != b:
                    side = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for c in p]
                    between = any(s == 0 and c not in (a, b) and min(a, b) < c < max(a, b) for s, c in zip(side, p))
                    if min(side) >= 0 and not between:
                        area += (a[0] * b[1] - b[0] * a[1]) / 2
        assert got[g] == pytest.approx(area, abs=1e-9)


def test_binary_neighbours_of_equal_vectors(spark, monkeypatch):
    r = random.Random(12)
    rows = [(i, [r.choice([0, 5, -3, 70000]), r.choice([1, 2, 1 << 40])]) for i in range(300)]
    x = spark.createDataFrame(rows, "id long, vec array<long>")
    seen, search = [], matching._search
    monkeypatch.setattr(matching, "_search", lambda q, d, *a: seen.append((q.count(), d.count())) or search(q, d, *a))
    for k in (1, 3, 60):
        got = sorted((y.i, y["rank"], y.d2, y.j) for y in matching.knn_binary(x.filter("id % 2 = 0"), x, k).collect())
        bits = lambda a, b: sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(a, b))
        near = lambda v: sorted((float(bits(v, w)), j) for j, w in rows)[:k]
        assert got == sorted((i, n + 1, d, j) for i, v in rows if i % 2 == 0 for n, (d, j) in enumerate(near(v)))
    assert seen == [(12, 12)] * 3  # equal vectors are compared once
