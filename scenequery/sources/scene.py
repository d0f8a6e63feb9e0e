"""Sinks of scenes - scene documents, point clouds, bundle text tables - and sources of clouds, sensors, cameras and descriptors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the version of the scene documents written.
VERSION = ["1", "2", "11"]


def scene_documents(scene: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Per part of a scene document, its elements as JSON text, a row each; scalars are strings, landmarks carry their observations."""
    text = lambda c, to=None: F.col(c).cast("string").alias(to or c)
    texts = lambda c, to: F.col(c).cast("array<string>").alias(to)
    json = lambda *c: F.to_json(F.struct(*c)).alias("value")
    out = {"views": scene["views"].select(json(text("view_id", "viewId"), text("pose_id", "poseId"), text("frame_id", "frameId"), text("intrinsic_id", "intrinsicId"), "path", text("width"), text("height"), "metadata"))}
    if "intrinsics" in scene:
        # scales in millimetres of the sensor's width, as documents have them from version 1.2 on
        mm = (F.col("scale")[0] * F.col("sensor_width") / F.col("width")).cast("string")
        out["intrinsics"] = scene["intrinsics"].select(json(text("intrinsic_id", "intrinsicId"), text("width"), text("height"), text("sensor_width", "sensorWidth"), text("sensor_height", "sensorHeight"), F.col("serial").alias("serialNumber"), "type", mm.alias("focalLength"), (F.col("scale")[0] / F.col("scale")[1]).cast("string").alias("pixelRatio"), texts("offset", "principalPoint"), F.col("distortion").alias("distortionType"), texts("params", "distortionParams"), F.col("locked").cast("int").cast("string").alias("locked")))
    out["poses"] = scene["poses"].select(json(text("pose_id", "poseId"), F.struct(F.struct(texts("rotation", "rotation"), texts("center", "center")).alias("transform"), F.col("locked").cast("int").cast("string").alias("locked")).alias("pose")))
    seen = F.sort_array(F.collect_list(F.struct(text("view_id", "observationId"), text("feat_id", "featureId"), texts("x", "x"), text("scale")))).alias("observations")
    seen = scene["observations"].groupBy("landmark_id").agg(seen)
    marks = scene["landmarks"].join(seen, "landmark_id", "left")
    out["structure"] = marks.select(json(text("landmark_id", "landmarkId"), F.col("desc_type").alias("descType"), texts("color", "color"), texts("x", "X"), F.coalesce("observations", F.array().cast("array<struct<observationId: string, featureId: string, x: array<string>, scale: string>>")).alias("observations")))
    return out


def write_scene(scene: dict[str, DataFrame], path: str) -> None:
    """A folder whose lines are scene documents of one element each, for read_scene_lines; no task holds a whole scene."""
    for k, (name, rows) in enumerate(scene_documents(scene).items()):
        lines = rows.select(F.concat(F.lit('{"version": ' + str(VERSION).replace("'", '"') + f', "{name}": ['), "value", F.lit("]}")).alias("value"))
        lines.write.mode("append" if k else "overwrite").text(path)


def read_scene_lines(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of write_scene's folder, a document a line, so that files can be split."""
    from scenequery.sources.text import scene_tables

    return scene_tables(spark, path, lines=True)


def _vector(c: str, n: int) -> Column:
    return F.concat_ws(" ", *[F.col(c)[k].cast("string") for k in range(n)])


def ply_lines(points: DataFrame) -> DataFrame:
    """(part, value): lines of an ASCII point cloud of points(x: array of 3, color: array of 3 ints or null, white); the header is part 0."""
    count = points.agg(F.count(F.lit(1)).alias("n"))
    head = ["ply", "format ascii 1.0", "element vertex %d", *[f"property double {c}" for c in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue")], "end_header"]
    top = count.select(F.lit(0).alias("part"), F.format_string("\n".join(head), "n").alias("value"))
    white = F.array(*[F.lit(255)] * 3)
    rows = points.withColumn("color", F.coalesce("color", white))
    return top.union(rows.select(F.lit(1), F.concat_ws(" ", _vector("x", 3), _vector("color", 3))))


def write_ply(points: DataFrame, path: str) -> None:
    """Part files in whose order the lines make a point cloud: the first has the header, as a union keeps its sides' order."""
    ply_lines(points).select("value").write.mode("overwrite").text(path)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(x: array of 3, color: array of 3 ints or null) of ASCII point clouds whose vertices are x y z, or these and 3 or 4 colors; triangles and quadrangles are skipped.

    Lines are dealt out as any text; those of the header don't begin with a number.
    A face of five or six corners would look like a vertex: such clouds aren't supported.
    """
    number = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter(F.col("value").rlike(rf"^{number}(\s+{number}){{2}}((\s+[0-9]+){{3,4}})?$"))
    w = F.split("value", r"\s+")
    return lines.select(F.slice(w, 1, 3).cast("array<double>").alias("x"), F.when(F.size(w) >= 6, F.slice(w, 4, 3).cast("array<int>")).alias("color"))


def bundle_tables(cameras: DataFrame, images: DataFrame, landmarks: DataFrame, observations: DataFrame) -> dict[str, DataFrame]:
    """Lines (value) of the text tables `cameras`, `images` and `points3D` that structure-from-motion tools exchange.

    cameras(intrinsic_id, model, width, height, params), images(view_id, q: w x y z,
    t, intrinsic_id, path), landmarks(landmark_id, x, color), observations(landmark_id,
    view_id, feat_id, x).  A view's points follow its line in order of feature; a track's elements name their place there.
    """
    numbers = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    out = {"cameras": cameras.select(F.concat_ws(" ", "intrinsic_id", "model", "width", "height", numbers("params")).alias("value"))}
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("view_id").orderBy("feat_id", "landmark_id")) - 1
    seen = observations.withColumn("at", at)
    points = seen.groupBy("view_id").agg(F.sort_array(F.collect_list(F.struct("at", F.concat_ws(" ", _vector("x", 2), F.col("landmark_id").cast("string")).alias("p")))).alias("s"))
    named = images.join(points, "view_id", "left")
    line = F.concat_ws(" ", "view_id", numbers("q"), numbers("t"), "intrinsic_id", "path")
    out["images"] = named.select(F.concat_ws("\n", line, F.coalesce(F.array_join("s.p", " "), F.lit(""))).alias("value"))
    tracks = seen.groupBy("landmark_id").agg(F.sort_array(F.collect_list(F.struct("view_id", "at"))).alias("s"))
    track = F.array_join(F.transform("s", lambda v: F.concat_ws(" ", v["view_id"].cast("string"), v["at"].cast("string"))), " ")
    out["points3D"] = landmarks.join(tracks, "landmark_id").select(F.concat_ws(" ", "landmark_id", _vector("x", 3), _vector("color", 3), F.lit("0"), track).alias("value"))
    return out


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    """(brand, model, width) of lines `brand;model;width;...`; lines that begin with # or have fewer than four fields are skipped."""
    w = F.split("value", ";")
    x = spark.read.text(path).filter(~F.col("value").startswith("#")).filter(F.size(w) >= 4)
    return x.select(F.trim(w[0]).alias("brand"), F.trim(w[1]).alias("model"), w[2].try_cast("double").alias("width"))


def read_camera_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, k, r: arrays of 9, t: array of 3) of lines of a name and 21 numbers; others (such as a count) are skipped."""
    w = F.split(F.trim("value"), r"\s+")
    v = F.slice(w, 2, 21).cast("array<double>")
    return spark.read.text(path).filter(F.size(w) == 22).select(w[0].alias("name"), F.slice(v, 1, 9).alias("k"), F.slice(v, 10, 9).alias("r"), F.slice(v, 19, 3).alias("t"))


#: Rows of descriptors in an Arrow batch.
ROWS = 4096


def read_descriptors(spark: SparkSession, path: str, size: int, kind: str = "uint8", most: int | None = None) -> DataFrame:
    """(view_id, desc_type, feat_id, descriptor: array<float>) of `<view>.<type>.desc` files: a 64-bit count, then rows of `size` numbers.

    Of each file at most `most` rows, if given; a file shorter than its count says is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.desc").load(path)
    name = F.split(F.element_at(F.split("path", "/"), -1), r"\.")
    files = files.select(name[0].cast("long").alias("view_id"), name[1].alias("desc_type"), "content")
    item = np.dtype(kind).newbyteorder("<")

    def parse(batches):
        for b in batches:
            for view, typ, raw in zip(*(b.column(k).to_pylist() for k in range(3))):
                n = int(np.frombuffer(raw, "<u8", 1)[0])
                x = np.frombuffer(raw, item, n * size, 8).reshape(n, size)[:most]
                for at in range(0, len(x), ROWS):
                    part = x[at : at + ROWS].astype(np.float32)
                    rows = len(part)
                    yield pa.record_batch([pa.array([view] * rows, pa.int64()), pa.array([typ] * rows), pa.array(np.arange(at, at + rows)), pa.array(list(part), pa.list_(pa.float32()))], ["view_id", "desc_type", "feat_id", "descriptor"])

    return files.mapInArrow(parse, "view_id long, desc_type string, feat_id long, descriptor array<float>")
