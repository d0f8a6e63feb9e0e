"""Sources and sinks of files of one view each."""

import json

import pytest

from scenequery.operators import matching
from scenequery.sources import files as S
from scenequery.sources import scene, text

F = S.F


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_features_and_descriptors(spark, tmp_path):
    f = [(v, k, i, i + 0.5, v * 2.0, 1.0, 0.25) for v in (3, 12) for k in ("sift", "akaze") for i in range(4)]
    df = spark.createDataFrame(f, "view_id long, desc_type string, feat_id long, x double, y double, scale double, orientation double").repartition(3)
    out = str(tmp_path / "f")
    assert sum(r.n for r in S.write_features(df, out).collect()) == 16
    assert rows(text.read_features(spark, out), "view_id", "desc_type", "feat_id") == sorted(f)
    d = [(v, "sift", i, [float((i * 7 + k) % 256) for k in range(8)]) for v in (3, 4) for i in range(5)]
    S.write_descriptors(spark.createDataFrame(d, "view_id long, desc_type string, feat_id long, descriptor array<float>"), out).collect()
    assert [(*r[:3], list(r[3])) for r in rows(scene.read_descriptors(spark, out, 8), "view_id", "feat_id")] == d
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "9.sift.desc").write_text("1 2 3\n4 5 6\n")
    assert rows(S.read_descriptor_texts(spark, str(tmp_path / "t")), "feat_id") == [(9, "sift", 0, [1, 2, 3]), (9, "sift", 1, [4, 5, 6])]


@pytest.mark.parametrize("per_view", [True, False])
def test_matches(spark, tmp_path, per_view):
    m = [(0, 1, "sift", 5, 6), (0, 2, "sift", 1, 2), (0, 1, "akaze", 3, 4), (7, 8, "sift", 0, 0)]
    blocks = text.match_blocks(spark.createDataFrame(m, text.MATCHES))
    made = S.write_matches(blocks, str(tmp_path), per_view).collect()
    assert len(made) == (2 if per_view else 1)
    assert rows(text.read_matches(spark, str(tmp_path)), "i", "j", "desc_type") == sorted(m)


def test_tracks(spark, tmp_path):
    t = [(0, "sift", 1, 5, 1.5, 2.0, 0.5), (0, "sift", 2, 6, 3.0, 4.0, 1.0), (3, "cctag3", 1, 9, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(t, "track long, kind string, view long, feat long, x double, y double, scale double")
    doc = "[" + ",".join(r.value for r in S.track_texts(df).orderBy("track").collect()) + "]"
    assert json.loads(doc)[0][1]["featPerView"][1][0] == 2
    (tmp_path / "t.json").write_text(doc)
    assert rows(S.read_tracks(spark, str(tmp_path / "t.json")), "track", "view") == t


def test_lights_listings_and_arrays(spark, tmp_path):
    (tmp_path / "l.txt").write_text("1 2 3\n4 5 6\n")
    p = str(tmp_path / "l.txt")
    assert [r[1:] for r in rows(S.read_light_intensities(spark, p), "no")] == [(0, 1, 2, 3), (1, 4, 5, 6)]
    assert [r[1:] for r in rows(S.read_light_directions(spark, p, [0, 1, 0, 1, 0, 0, 0, 0, -1]), "no")][0] == (0, 2, 1, -3)
    (tmp_path / "h.txt").write_text("1 2 3 4 5 6 7 8 9\n")
    assert S.read_light_harmonics(spark, str(tmp_path / "h.txt")).first().c == [1, -2, -3, 4, 5, 6, 7, 8, 9]
    lights = spark.createDataFrame([("a", 1), ("ab", 2)], "name string, no int")
    assert rows(S.lights_of(lights, spark.createDataFrame([("xab.png",), ("a.png",)], "name string")), "picture") == [("a.png", "a", 1), ("xab.png", "ab", 2)]
    found = S.list_files(spark, [str(tmp_path)], r".*\.txt")
    assert sorted(r.name for r in found.collect()) == ["h.txt", "l.txt"]
    views = spark.createDataFrame([(1, "/q/l.jpg"), (2, "/q/z.jpg")], "view_id long, path string")
    assert [r.view_id for r in S.files_of_views(views, found).collect()] == [1]
    S.save_array(spark.createDataFrame([(2, 5.5), (1, 4.0)], "o int, v double"), "v", "o", str(tmp_path / "a"), "x.bin").collect()
    assert [r[1:] for r in rows(S.load_arrays(spark, str(tmp_path / "a")), "no")] == [(0, 4.0), (1, 5.5)]
    x = spark.createDataFrame([(1, 0.5, None)], "frame int, sharp double, flow double")
    assert [r[0] for r in S.score_lines(x, x.columns).collect()] == ["frame;sharp;flow", "1;0.5;"]
    m = spark.createDataFrame([(2, [3.0, 4.0]), (1, [1.0, 2.0])], "k int, v array<double>")
    assert [r[0] for r in S.matrix_lines(m, "v", "k").collect()] == ["1.0 2.0", "3.0 4.0"]


def test_report_and_regions(spark):
    v = spark.createDataFrame([(1,), (2,)], "view_id long")
    o = spark.createDataFrame([(1, 3.0), (1, -4.0), (1, 0.0)], "view_id long, r double")
    got = {r.view_id: (r.n, r.median) for r in S.scene_report(v, o, F.abs("r")).collect()}
    assert got == {1: (3, 3.0), 2: (0, None)}
    q = spark.createDataFrame([(1, [0.0, 0.0], 5.0, 5.0), (2, [0.1, 0.0], 5.0, 5.0)], "id long, vec array<double>, x double, y double")
    d = spark.createDataFrame([(7, [0.0, 0.0], 1.0, 1.0), (8, [9.0, 9.0], 2.0, 2.0)], "id long, vec array<double>, x double, y double")
    assert [tuple(r)[:2] for r in matching.match_regions(q, d, 0.8).collect()] == [(1, 7)]
