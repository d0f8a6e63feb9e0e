"""Text files of pairs, features and matches, and scene documents, as tables.

A file of features or matches holds one view and is read whole, so that places
in it are known; files are dealt out over tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenequery.operators import pairs as pair_ops

MATCHES = "i long, j long, desc_type string, fi long, fj long"
CHUNK = 100_000


def read_pairs(spark: SparkSession, path: str, start: int | None = None, size: int = 0) -> DataFrame:
    """Distinct (i, j), i < j, of adjacency lines `I J K ...`; of a file's lines from `start` on only `size`, if given.

    A line without a partner, or with itself as one, is an error when it is read.
    """
    if start is None or not size:
        lines = spark.read.text(path)
    else:
        whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")))
        lines = whole.filter(F.col("pos").between(start, start + size - 1)).select(F.col("col").alias("value"))
    words = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "[\t ]+")
    x = lines.select(F.when(F.size(words) < 2, F.raise_error(F.lit("a line of a pair list needs two ids"))).otherwise(words).cast("array<long>").alias("ids"))
    x = x.select(F.col("ids")[0].alias("i"), F.explode(F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(0)))).alias("j"))
    x = x.withColumn("j", F.when(F.col("i") == F.col("j"), F.raise_error(F.lit("a view is paired with itself"))).otherwise(F.col("j")))
    return x.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def write_pairs(pairs: DataFrame, path: str) -> None:
    """A line for each first id, ascending over the part files."""
    pair_ops.adjacency(pairs).orderBy("i").select("line").write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(view_id, desc_type, feat_id, x, y, scale, orientation) of `<view>.<type>.feat` files; feat_id is the line's place."""
    files = spark.read.option("pathGlobFilter", "*.feat").text(path, wholetext=True)
    name = F.split(F.col("_metadata.file_name"), r"\.")
    x = files.select(name[0].cast("long").alias("view_id"), name[1].alias("desc_type"), F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("feat_id", "line"))
    v = F.split(F.trim("line"), r"\s+").cast("array<double>")
    return x.filter("line != ''").select("view_id", "desc_type", F.col("feat_id").cast("long").alias("feat_id"), *[v[k].alias(n) for k, n in enumerate(["x", "y", "scale", "orientation"])])


def _parse_matches(batches):
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words, rows = iter(text.split()), []
            for i in words:
                j = next(words)
                for _ in range(int(next(words))):
                    kind = next(words)
                    for _ in range(int(next(words))):
                        rows.append((int(i), int(j), kind, int(next(words)), int(next(words))))
                        if len(rows) == CHUNK:
                            yield _match_rows(rows)
                            rows = []
            yield _match_rows(rows)


def _match_rows(rows: list) -> pa.RecordBatch:
    kinds = {"i": pa.int64(), "j": pa.int64(), "desc_type": pa.string(), "fi": pa.int64(), "fj": pa.int64()}
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, desc_type, fi, fj) of all `*matches.txt` files below path; a file cut off short is an error."""
    files = spark.read.option("pathGlobFilter", "*matches.txt").option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select("value").mapInArrow(_parse_matches, MATCHES)


def match_blocks(matches: DataFrame) -> DataFrame:
    """(i, j, value): a pair's block of a match file, types and matches in ascending order."""
    line = F.concat_ws(" ", "fi", "fj")
    kinds = matches.groupBy("i", "j", "desc_type").agg(F.sort_array(F.collect_list(F.struct("fi", "fj", line.alias("line")))).alias("m"))
    kinds = kinds.withColumn("text", F.concat_ws("\n", F.concat_ws(" ", "desc_type", F.size("m").cast("string")), F.array_join(F.col("m.line"), "\n")))
    x = kinds.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("desc_type", "text"))).alias("k"))
    return x.select("i", "j", F.concat_ws("\n", F.concat_ws(" ", "i", "j"), F.size("k").cast("string"), F.array_join(F.col("k.text"), "\n")).alias("value"))


SCENE = """version array<string>,
views array<struct<viewId: string, poseId: string, frameId: string, intrinsicId: string, path: string, width: string, height: string, metadata: map<string, string>>>,
intrinsics array<struct<intrinsicId: string, width: string, height: string, sensorWidth: string, sensorHeight: string, serialNumber: string, type: string, pxFocalLength: string, focalLength: string, pixelRatio: string, principalPoint: array<string>, distortionType: string, distortionParams: array<string>, locked: string>>,
poses array<struct<poseId: string, pose: struct<transform: struct<rotation: array<string>, center: array<string>>, locked: string>>>,
structure array<struct<landmarkId: string, descType: string, color: array<string>, X: array<string>, observations: array<struct<observationId: string, featureId: string, x: array<string>, scale: string>>>>"""


def read_scene(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables views, intrinsics, poses, landmarks and observations of scene documents, whose scalars are strings; a missing poseId is the viewId.

    An intrinsic's scale is in pixels: given as such, or (from version 1.2 on) in millimetres of the sensor's width, the
    vertical one over the pixel ratio.  Its offset is that of the principal point from the image's middle, which
    documents before version 1.2.1 place from the image's corner.
    """
    return scene_tables(spark, path)


def scene_tables(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """The tables of read_scene; with `lines`, each line of a file is a document."""
    doc = spark.read.option("multiLine", not lines).option("caseSensitive", True).schema(SCENE).json(path)
    part = lambda c: doc.select(F.explode(c).alias("r"))
    whole = lambda c, to=None: F.col(f"r.{c}").cast("long").alias(to or c)
    views = part("views").select(whole("viewId", "view_id"), F.coalesce(whole("poseId"), whole("viewId")).alias("pose_id"), whole("frameId", "frame_id"), whole("intrinsicId", "intrinsic_id"), F.col("r.path").alias("path"), F.coalesce(whole("width"), F.lit(0)).alias("width"), F.coalesce(whole("height"), F.lit(0)).alias("height"), F.col("r.metadata").alias("metadata"))
    numbers = lambda c, to: F.col(f"r.{c}").cast("array<double>").alias(to)
    v = F.transform("version", lambda x: x.cast("int"))
    lens = doc.select(F.array_join(F.transform(v, lambda x: F.lpad(x.cast("string"), 4, "0")), ".").alias("v"), F.explode("intrinsics").alias("r"))
    real = lambda c, default=None: F.coalesce(F.col(f"r.{c}").cast("double"), F.lit(default).cast("double"))
    size = [F.coalesce(F.col(f"r.{c}").cast("long"), F.lit(0)) for c in ("width", "height")]
    scale = F.coalesce(F.when(real("pxFocalLength") > 0, real("pxFocalLength")), real("focalLength") * size[0] / real("sensorWidth", 36.0))
    middle = [F.when(F.col("v") < "0001.0002.0001", s / 2).otherwise(0.0) for s in size]
    point = F.col("r.principalPoint").cast("array<double>")
    offset = F.array(*[F.coalesce(point[k], F.lit(0.0)) - middle[k] for k in (0, 1)])
    intrinsics = lens.select(whole("intrinsicId", "intrinsic_id"), size[0].alias("width"), size[1].alias("height"), real("sensorWidth", 36.0).alias("sensor_width"), real("sensorHeight", 24.0).alias("sensor_height"), F.col("r.serialNumber").alias("serial"), F.col("r.type").alias("type"), F.array(scale, scale / real("pixelRatio", 1.0)).alias("scale"), offset.alias("offset"), F.col("r.distortionType").alias("distortion"), F.coalesce(F.col("r.distortionParams").cast("array<double>"), F.array().cast("array<double>")).alias("params"), F.coalesce(F.col("r.locked").isin("1", "true"), F.lit(False)).alias("locked"))
    poses = part("poses").select(whole("poseId", "pose_id"), numbers("pose.transform.rotation", "rotation"), numbers("pose.transform.center", "center"), F.coalesce(F.col("r.pose.locked") == "1", F.lit(False)).alias("locked"))
    landmarks = part("structure").select(whole("landmarkId", "landmark_id"), F.col("r.descType").alias("desc_type"), numbers("X", "x"), F.col("r.color").cast("array<int>").alias("color"))
    seen = part("structure").select(F.col("r.landmarkId").cast("long").alias("landmark_id"), F.explode("r.observations").alias("r"))
    observations = seen.select("landmark_id", whole("observationId", "view_id"), whole("featureId", "feat_id"), numbers("x", "x"), F.coalesce(F.col("r.scale").cast("double"), F.lit(0.0)).alias("scale"))
    return {"views": views, "intrinsics": intrinsics, "poses": poses, "landmarks": landmarks, "observations": observations}
