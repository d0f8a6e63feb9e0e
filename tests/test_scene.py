import glob
import struct

import numpy as np
import pytest

from scenequery.sources import scene as S
from scenequery.sources import text as T


@pytest.fixture(scope="module")
def tables(spark):
    one = spark.createDataFrame
    return {
        "views": one([(1, 1, 0, 7, "a.jpg", 640, 480, {"k": "v"}), (2, 5, 1, 7, 'b "q".jpg', 640, 480, None)], "view_id long, pose_id long, frame_id long, intrinsic_id long, path string, width long, height long, metadata map<string,string>"),
        "intrinsics": one([(7, 640, 480, 32.0, 24.0, "s1", "pinhole", [500.0, 500.0], [1.5, -2.0], "radialk3", [0.1, 0.0, -0.5], False), (8, 100, 50, 36.0, 24.0, None, "equidistant", [50.0, 25.0], [0.0, 0.0], "none", [], True)], "intrinsic_id long, width long, height long, sensor_width double, sensor_height double, serial string, type string, scale array<double>, offset array<double>, distortion string, params array<double>, locked boolean"),
        "poses": one([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.5, -1.25, 3e-7], True)], "pose_id long, rotation array<double>, center array<double>, locked boolean"),
        "landmarks": one([(10, "sift", [1.0, 2.0, 3.5], [1, 2, 3]), (11, "sift", [0.0, 0.0, 1.0], [9, 9, 9])], "landmark_id long, desc_type string, x array<double>, color array<int>"),
        "observations": one([(10, 1, 4, [10.5, 20.0], 1.5), (10, 2, 9, [1.0, 2.0], 0.0)], "landmark_id long, view_id long, feat_id long, x array<double>, scale double"),
    }


def plain(df):
    return sorted(str(r.asDict(True)) for r in df.collect())


def test_scene_round_trip(spark, tmp_path, tables):
    path = str(tmp_path / "scene")
    S.write_scene({k: v.repartition(3) for k, v in tables.items()}, path)
    back = S.read_scene_lines(spark, path)
    for name in tables:
        assert plain(back[name]) == plain(tables[name]), name
    (tmp_path / "one.sfm").write_text(S.scene_documents(tables)["views"].first().value.join(['{"version": ["1"], "views": [', "]}"]))
    assert plain(T.read_scene(spark, str(tmp_path / "one.sfm"))["views"]) == plain(tables["views"].limit(1))


def test_old_intrinsics(spark, tmp_path):
    """Focal lengths in pixels, and principal points from the corner, of documents before version 1.2."""
    (tmp_path / "old.sfm").write_text('{"version": ["1", "1", "0"], "intrinsics": [{"intrinsicId": "3", "width": "200", "height": "100", "type": "radial3", "pxFocalLength": "150.5", "principalPoint": ["101", "49"]}]}')
    r = T.read_scene(spark, str(tmp_path / "old.sfm"))["intrinsics"].first()
    assert (r.scale, r.offset, r.sensor_width, r.params, r.locked) == ([150.5, 150.5], [1.0, -1.0], 36.0, [], False)


def test_ply(spark, tmp_path, tables):
    path = str(tmp_path / "cloud")
    S.write_ply(tables["landmarks"], path)
    whole = "".join(open(f).read() for f in sorted(glob.glob(path + "/part-*")))
    assert whole.startswith("ply\nformat ascii 1.0\nelement vertex 2\n")
    got = {tuple(r.x): r.color for r in S.read_ply(spark, path).collect()}
    assert got == {(1.0, 2.0, 3.5): [1, 2, 3], (0.0, 0.0, 1.0): [9, 9, 9]}
    (tmp_path / "f.ply").write_text("ply\nelement vertex 1\nend_header\n1e-3 -.5 2.\n3 0 0 0\n4 0 0 0 0\n")
    assert [(r.x, r.color) for r in S.read_ply(spark, str(tmp_path / "f.ply")).collect()] == [([0.001, -0.5, 2.0], None)]


def test_bundle(spark, tables):
    cams = spark.createDataFrame([(7, "PINHOLE", 640, 480, [500.0, 500.0, 320.0, 240.0])], "intrinsic_id long, model string, width long, height long, params array<double>")
    images = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0], 7, "a.jpg"), (3, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0], 7, "c.jpg")], "view_id long, q array<double>, t array<double>, intrinsic_id long, path string")
    out = {k: sorted(r.value for r in v.collect()) for k, v in S.bundle_tables(cams, images, tables["landmarks"], tables["observations"]).items()}
    assert out["cameras"] == ["7 PINHOLE 640 480 500.0 500.0 320.0 240.0"]
    assert out["images"] == ["1 1.0 0.0 0.0 0.0 0.0 0.0 0.0 7 a.jpg\n10.5 20.0 10", "3 1.0 0.0 0.0 0.0 0.0 0.0 0.0 7 c.jpg\n"]
    assert out["points3D"] == ["10 1.0 2.0 3.5 1 2 3 0 1 0 2 0"]


def test_sensors_and_cameras(spark, tmp_path):
    (tmp_path / "s.db").write_text("# a;b;1;c\nBrand;Brand One;7.144;x\nshort;y;1\nBrand;Odd;wide;x\n")
    assert [tuple(r) for r in S.read_sensors(spark, str(tmp_path / "s.db")).collect()] == [("Brand", "Brand One", 7.144), ("Brand", "Odd", None)]
    (tmp_path / "c.txt").write_text("1\nv.png " + " ".join(str(k) for k in range(21)) + "\n")
    r = S.read_camera_list(spark, str(tmp_path / "c.txt")).first()
    assert r.name == "v.png" and r.k == list(range(9)) and r.r == list(range(9, 18)) and r.t == [18, 19, 20]


def test_descriptors(spark, tmp_path):
    x = np.arange(40, dtype=np.uint8).reshape(5, 8)
    (tmp_path / "12.sift.desc").write_bytes(struct.pack("<Q", 5) + x.tobytes())
    (tmp_path / "13.sift.desc").write_bytes(struct.pack("<Q", 0))
    got = S.read_descriptors(spark, str(tmp_path), 8).orderBy("feat_id").collect()
    assert [(r.view_id, r.desc_type, r.feat_id) for r in got] == [(12, "sift", k) for k in range(5)]
    assert [r.descriptor for r in got] == x.tolist()
    assert S.read_descriptors(spark, str(tmp_path), 8, most=2).count() == 2
    (tmp_path / "14.sift.desc").write_bytes(struct.pack("<Q", 9) + x.tobytes())
    with pytest.raises(Exception, match="reshape|buffer"):
        S.read_descriptors(spark, str(tmp_path), 8).collect()
