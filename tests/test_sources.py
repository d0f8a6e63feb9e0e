import json

import pytest

from scenequery.sources import text as T


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_pairs(spark, tmp_path):
    (tmp_path / "p.txt").write_text(" 0 2 4 5\n0 1\n9\t5\n")
    path = str(tmp_path / "p.txt")
    assert rows(T.read_pairs(spark, path), "i", "j") == [(0, 1), (0, 2), (0, 4), (0, 5), (5, 9)]
    assert rows(T.read_pairs(spark, path, 1, 2), "i", "j") == [(0, 1), (5, 9)]
    out = str(tmp_path / "out")
    pairs = spark.createDataFrame([(0, 2), (0, 4), (0, 5), (8, 2), (0, 1), (5, 9)], "i long, j long")
    T.write_pairs(pairs, out)
    lines = sorted(r.value for r in spark.read.text(out).collect())
    assert lines == ["0 1 2 4 5", "5 9", "8 2"]


@pytest.mark.parametrize("bad", ["3\n", "1 2 1\n", "\n"])
def test_bad_pairs(spark, tmp_path, bad):
    (tmp_path / "p.txt").write_text(bad)
    with pytest.raises(Exception, match="pair"):
        T.read_pairs(spark, str(tmp_path / "p.txt")).collect()


def test_features(spark, tmp_path):
    (tmp_path / "7.sift.feat").write_text("1 2 3 0.5\n4 5 6 1e-1\n")
    (tmp_path / "8.akaze.feat").write_text("")
    (tmp_path / "7.sift.desc").write_text("no")
    assert rows(T.read_features(spark, str(tmp_path)), "feat_id") == [(7, "sift", 0, 1.0, 2.0, 3.0, 0.5), (7, "sift", 1, 4.0, 5.0, 6.0, 0.1)]


def test_matches_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 2)
    want = [(0, 1, "akaze", 5, 6), (0, 1, "sift", 0, 0), (0, 1, "sift", 2, 10), (0, 1, "sift", 10, 3), (1, 2, "sift", 4, 4)]
    blocks = T.match_blocks(spark.createDataFrame(want[::-1], T.MATCHES))
    for r in blocks.collect():
        with open(tmp_path / f"{r.i}.matches.txt", "a") as f:
            f.write(r.value + "\n")
    assert (tmp_path / "0.matches.txt").read_text() == "0 1\n2\nakaze 1\n5 6\nsift 3\n0 0\n2 10\n10 3\n"
    assert rows(T.read_matches(spark, str(tmp_path)), "i", "j", "desc_type", "fi") == want


def test_scene(spark, tmp_path):
    doc = {
        "version": ["1", "2", "0"],
        "views": [{"viewId": "11", "intrinsicId": "5", "path": "a.jpg", "width": "40", "height": "30", "metadata": {"k": "v"}}, {"viewId": "12", "poseId": "3"}],
        "poses": [{"poseId": "3", "pose": {"transform": {"rotation": [str(k) for k in range(9)], "center": ["1", "2", "3.5"]}, "locked": "1"}}],
        "structure": [{"landmarkId": "1", "descType": "sift", "color": ["1", "2", "3"], "X": ["0", "1", "2"], "observations": [{"observationId": "11", "featureId": "4", "x": ["5.5", "6"]}]}],
    }
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    t = T.read_scene(spark, str(tmp_path / "s.json"))
    assert rows(t["views"], "view_id") == [(11, 11, None, 5, "a.jpg", 40, 30, {"k": "v"}), (12, 3, None, None, None, 0, 0, None)]
    assert rows(t["poses"], "pose_id") == [(3, [float(k) for k in range(9)], [1.0, 2.0, 3.5], True)]
    assert rows(t["landmarks"], "landmark_id") == [(1, "sift", [0.0, 1.0, 2.0], [1, 2, 3])]
    assert rows(t["observations"], "landmark_id") == [(1, 11, 4, [5.5, 6.0], 0.0)]
