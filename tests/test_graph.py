"""Graph operators against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from scenequery.operators import blocks, graph, matching, scenes, stats, tracks


def walk(near, source):
    at, front, step = {source: 0}, [source], 0
    while front:
        step += 1
        front = {w for v in front for w in near[v]} - at.keys()
        at |= dict.fromkeys(front, step)
    return at


def neighbours(edges):
    near = defaultdict(set)
    for i, j in edges:
        near[i].add(j)
        near[j].add(i)
    return near


def random_edges(seed, n, m):
    r = random.Random(seed)
    return sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)})


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    for edges in (random_edges(1, 60, 40), [(v, v + 1) for v in range(30)], []):
        near, label = neighbours(edges), {}
        for v in sorted(near):
            if v not in label:
                label |= dict.fromkeys(walk(near, v), v)
        got = {r.v: r.component for r in graph.components(spark.createDataFrame(edges, "i long, j long")).collect()}
        assert got == label


@pytest.mark.parametrize("block", [1 << 18, 20])
def test_bridges(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    for seed in (2, 3):
        edges = random_edges(seed, 40, 50)
        near = neighbours(edges)
        want = set()
        for i, j in edges:
            near[i].discard(j)
            near[j].discard(i)
            if j not in walk(near, i):
                want.add((i, j))
            near[i].add(j)
            near[j].add(i)
        df = spark.createDataFrame([(j, i) for i, j in edges] + edges, "i long, j long")
        assert {tuple(r) for r in graph.bridges(df).collect()} == want
        left = neighbours([e for e in edges if e not in want])
        sizes = {v: walk(left, v) for v in left}
        top = max(sizes.values(), key=lambda s: (len(s), -min(s)))
        assert {r.v for r in graph.without_bridges(df).collect()} == set(top)


def test_spanning_forest(spark):
    r = random.Random(5)
    edges = [(i, j, r.randrange(9)) for i, j in random_edges(4, 30, 60)]
    up, want = {}, set()

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, j, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if root(i) != root(j):
            up[root(i)] = root(j)
            want.add((i, j, w))
    assert {tuple(x) for x in graph.spanning_forest(spark.createDataFrame(edges, "i long, j long, weight long")).collect()} == want
    assert graph.spanning_forest(spark.createDataFrame([], "i long, j long, weight long")).count() == 0


@pytest.mark.parametrize("edges, n", [([("a", "b"), ("b", "c")], 0), ([("a", "b"), ("a", "c"), ("b", "c")], 1), ([("a", "b"), ("a", "c"), ("a", "d"), ("c", "d"), ("b", "d")], 2), ([("a", "b"), ("b", "c"), ("c", "e"), ("b", "e"), ("b", "d"), ("a", "d")], 2)])
def test_triangle_fixtures(spark, edges, n):
    df = spark.createDataFrame([tuple(sorted("abcde".index(v) for v in e)) for e in edges], "i long, j long")
    got = [tuple(r) for r in graph.triangles(df).collect()]
    assert len(got) == n and all(a < b < c for a, b, c in got)


def test_triangles(spark):
    edges = random_edges(6, 30, 150)
    have = set(edges)
    want = {c for c in combinations(range(30), 3) if all(p in have for p in combinations(c, 2))}
    assert {tuple(r) for r in graph.triangles(spark.createDataFrame(edges, "i long, j long")).collect()} == want


def test_distances_until_nothing_is_left(spark):
    chain = [(v, v + 1) for v in range(12)] + [(0, 3), (100, 101), (101, 102)]
    near = neighbours(chain)
    want = dict.fromkeys(near, -1) | walk(near, 0)
    df = spark.createDataFrame(chain, "i long, j long")
    assert sorted(map(tuple, graph.distances(df, 0).collect())) == sorted(want.items())
    assert want[12] == 10 and want[102] == -1
    both = {v: min(x for x in (want[v], walk(near, 102).get(v, 99)) if x >= 0) for v in want}
    got = graph.states(graph.distances(df, [0, 102]), 2).collect()
    assert {r.v: r.distance for r in got} == both
    assert all(r.state == ("refined" if r.distance <= 2 else "constant" if r.distance == 3 else "ignored") for r in got)


def test_tracks_from_matches(spark):
    """Two chains of three views, a fork, and a feature number that both kinds have."""
    ab, bc = [(0, 0), (1, 1), (2, 3)], [(0, 0), (1, 6), (3, 2), (3, 8)]
    rows = [(0, 1, "a", *m) for m in ab] + [(1, 2, "a", *m) for m in bc] + [(0, 1, "b", 0, 0)]
    df = spark.createDataFrame(rows, "i long, j long, kind string, fi long, fj long")
    x = tracks.build(df)
    found = defaultdict(set)
    for r in x.collect():
        found[r.track].add((r.kind, r.view, r.feat))
    a = lambda *p: frozenset(("a", v, f) for v, f in p)
    assert set(map(frozenset, found.values())) == {a((0, 0), (1, 0), (2, 0)), a((0, 1), (1, 1), (2, 6)), a((0, 2), (1, 3), (2, 2), (2, 8)), frozenset({("b", 0, 0), ("b", 1, 0)})}
    plain = x.select("track", "view", "feat")
    assert tracks.filter_tracks(plain, 3).count() == 2 and tracks.kept_tracks(x, 2).select("track").distinct().count() == 3
    assert sorted(r.track for r in tracks.numbered(x).select("track").distinct().collect()) == [0, 1, 2, 3]
    assert tracks.count(x).first().n == 4 and sorted(r.view for r in tracks.views_of(x).collect()) == [0, 1, 2]
    assert "Class: " in tracks.text(x).first().line
    assert tracks.build(df.limit(0)).count() == 0


def brute_tracks(rows):
    """The track of each feature of matches (i, j, kind, fi, fj)."""
    near = defaultdict(set)
    for i, j, k, fi, fj in rows:
        near[k, i, fi].add((k, j, fj)), near[k, j, fj].add((k, i, fi))
    number, track = {x: n for n, x in enumerate(sorted(near), 1)}, {}
    for x in sorted(near):
        todo = [] if x in track else [x]
        while todo:
            y = todo.pop()
            if y not in track:
                track[y] = number[x]
                todo += near[y]
    return track


def test_tracks_in_blocks(spark, monkeypatch):
    """Chains, a hub and repeated matches over many blocks: a track's id is the number of its least feature."""
    r = random.Random(6)
    rows = [(v, v + 1, r.choice("ab"), f, f) for f in range(12) for v in range(30) if r.random() < 0.9]
    rows += [(40, 41, "a", f, 7) for f in range(300)] + [(r.randrange(5), 5 + r.randrange(5), "b", r.randrange(-20, 60), r.randrange(60)) for _ in range(60)] * 2 + [(3, 3, "c", -5, -5)]
    frame = lambda rows: spark.createDataFrame(rows, "i int, j long, kind string, fi long, fj int")
    got = lambda d: {(x.kind, x.view, x.feat): x.track for x in tracks.build(d).collect()}
    # features too far apart to be numbers with views and kinds
    far = [(i, j, k, fi + (1 << 61) * (i % 2), fj) for i, j, k, fi, fj in rows]
    assert got(frame(far)) == brute_tracks(far)
    df, want = frame(rows).repartition(5), brute_tracks(rows)
    assert got(df) == want
    for edges, block in ((50, 1 << 18), (20, 10)):
        monkeypatch.setattr(blocks, "EDGES", edges)
        monkeypatch.setattr(blocks, "CHUNK", 100)
        monkeypatch.setattr(blocks, "HOT", 8)
        monkeypatch.setattr(graph, "BLOCK", block)
        assert got(df) == want


def test_tracks_build_deals_features_out_once(spark, sf):
    """No step of tracks_build after the tracks are known deals them out but once, for both counts."""
    from scenequery.plans.scene_queries import tracks_build

    plan = tracks_build(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(track") == 1 and "Exchange hashpartitioning(size" in plan


def test_nearest_of_all_others(spark):
    """Rows of id % 20 = 0 are found too, the query itself never, however many equal rows there are."""
    vecs = {0: [0.0], 20: [0.1], 40: [5.0], 1: [1.0], 60: [7.0], 61: [7.0], 62: [7.0], 80: [7.0]}
    x = spark.createDataFrame(list(vecs.items()), "id long, vec array<double>")
    got = matching.knn_others(x.filter("id % 20 = 0"), x, 2).collect()
    want = set()
    for i in [v for v in vecs if v % 20 == 0]:
        near = sorted(((vecs[i][0] - vecs[j][0]) ** 2, j) for j in vecs if j != i)[:2]
        want |= {(i, j, rank) for rank, (_, j) in enumerate(near, 1)}
    assert {(r["i"], r["j"], r["rank"]) for r in got} == want
    assert (0, 20, 1) in want


def cascade(rows):
    while True:
        left = [r for r in rows if sum(x[0] == r[0] for x in rows) >= 2]
        left = [r for r in left if sum(x[1] == r[1] for x in left) >= 2]
        if left == rows:
            return rows
        rows = left


def test_removals_that_cascade(spark):
    """A chain that loses a row at its end in each round; two rounds leave most of it."""
    rows = [(k, k) for k in range(8)] + [(k + 1, k) for k in range(8)]
    ring = [(100, 100), (100, 101), (101, 100), (101, 101)]
    got = stats.stable_rows(spark.createDataFrame(rows + ring, "a long, b long"), "a", 2, "b", 2).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(cascade(rows) + ring) == sorted(ring)
    views = spark.createDataFrame([(v, v, 0) for v in [*range(9), 100, 101, 500]], "view_id long, pose_id long, intrinsic_id long")
    obs = spark.createDataFrame([(b, a) for a, b in rows + ring], "landmark_id long, view_id long")
    v, o = scenes.stable_scene(views, obs, 2, 2)
    assert sorted(map(tuple, o.collect())) == sorted((b, a) for a, b in ring) and sorted(r.view_id for r in v.collect()) == [100, 101]


@pytest.mark.parametrize("most", [300_000, 3])
def test_triangles_by_groups(spark, monkeypatch, most):
    """Dense, with a hub, and in many groups; wedges are neither joined nor exchanged."""
    monkeypatch.setattr(graph, "EDGES", most)
    edges = sorted({*random_edges(7, 40, 500), *((0, v) for v in range(1, 200)), *random_edges(8, 200, 300)})
    near = neighbours(edges)
    want = sorted((a, b, c) for a, b in edges for c in near[a] & near[b] if c > b)
    df = graph.triangles(spark.createDataFrame(edges, "i long, j long"))
    assert sorted(map(tuple, df.collect())) == want
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert graph.triangles(spark.createDataFrame([], "i long, j long")).count() == 0


def test_triangles_deal_edges_out_once(spark, monkeypatch, tmp_path):
    """However many groups there are, an edge is written once by its groups; triangles are neither exchanged nor made from copies of edges."""
    monkeypatch.setattr(graph, "EDGES", 5)
    edges = random_edges(10, 40, 300)
    monkeypatch.setattr(graph, "_shared", lambda spark: f"file://{tmp_path}/{len(list(tmp_path.iterdir()))}")
    df = graph.triangles(spark.createDataFrame(edges, "i long, j long"))
    rows = [spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()]
    assert rows == [len(edges)] * 2
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Repartition", "Generate", "Sort"))
    near = neighbours(edges)
    assert sorted(map(tuple, df.collect())) == sorted((a, b, c) for a, b in edges for c in near[a] & near[b] if c > b)


@pytest.mark.parametrize("wedges, table", [(1 << 20, 1 << 25), (5, 0), (5, 1 << 25)])
def test_closed_wedges(monkeypatch, wedges, table):
    monkeypatch.setattr(graph, "TABLE", table)
    r = np.random.default_rng(9)
    ab, ac, bc = (np.unique(r.integers(0, 12, (60, 2)) + s, axis=0) for s in ([0, 100], [0, 200], [100, 200]))
    got = sorted((int(u), int(v), int(w)) for t in graph._closed(ab, ac, bc, wedges) for u, v, w in zip(*t))
    x, y = set(map(tuple, ac.tolist())), set(map(tuple, bc.tolist()))
    assert got == sorted((u, v, w) for u, v in ab.tolist() for w in range(200, 212) if (u, w) in x and (v, w) in y)
    assert not list(graph._closed(ab, ac[:0], bc, wedges))
