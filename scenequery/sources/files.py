"""Files of one view each: writers of features, descriptors and matches; tracks, lights, listings, arrays, score tables, reports.

A file is written by the one task that holds its view (or pair), under the exact
name that its readers expect; pyarrow's file systems reach shared folders too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenequery.operators import stats

MANIFEST = "path string, n bigint"


def _put(folder: str, name: str, data: bytes) -> str:
    from pyarrow import fs as pafs

    fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(data)
    return f"{folder}/{name}"


def _file_per(rows: DataFrame, by: list[str], order: list[str], name, body, folder: str) -> DataFrame:
    """(path, n) of a file for each group, written whole by the task that holds the group; name(key), body(table)."""

    def write(key, t):
        t = t.sort_by([(c, "ascending") for c in order])
        return pa.table({"path": [_put(folder, name(*(k.as_py() for k in key)), body(t))], "n": [t.num_rows]})

    return rows.groupBy(*by).applyInArrow(write, MANIFEST)


def write_features(features: DataFrame, folder: str) -> DataFrame:
    """`<view>.<type>.feat`: a line "x y scale orientation" a feature, in the order of feat_id; returns (path, n) and writes when that is read."""
    def body(t):
        lines = zip(*(t.column(c).to_pylist() for c in ("x", "y", "scale", "orientation")))
        return "".join(" ".join(map(repr, r)) + "\n" for r in lines).encode()

    return _file_per(features, ["view_id", "desc_type"], ["feat_id"], lambda v, k: f"{v}.{k}.feat", body, folder)


def write_descriptors(descriptors: DataFrame, folder: str, kind: str = "uint8") -> DataFrame:
    """`<view>.<type>.desc`: a 64-bit count, then rows of numbers."""
    def body(t):
        x = t.column("descriptor").combine_chunks()
        return int(t.num_rows).to_bytes(8, "little") + x.flatten().to_numpy().astype(np.dtype(kind).newbyteorder("<")).tobytes()

    return _file_per(descriptors, ["view_id", "desc_type"], ["feat_id"], lambda v, k: f"{v}.{k}.desc", body, folder)


def read_descriptor_texts(spark: SparkSession, path: str) -> DataFrame:
    """(view_id, desc_type, feat_id, descriptor) of text files `<view>.<type>.desc` with a row of numbers a line."""
    files = spark.read.option("pathGlobFilter", "*.desc").text(path, wholetext=True)
    name = F.split(F.col("_metadata.file_name"), r"\.")
    x = files.select(name[0].cast("long").alias("view_id"), name[1].alias("desc_type"), F.posexplode(F.split(F.rtrim("value"), "\n")).alias("feat_id", "line"))
    return x.filter(F.trim("line") != "").select("view_id", "desc_type", F.col("feat_id").cast("long").alias("feat_id"), F.split(F.trim("line"), r"\s+").cast("array<float>").alias("descriptor"))


def write_matches(blocks: DataFrame, folder: str, per_view: bool, prefix: str = "") -> DataFrame:
    """Match files of blocks(i, j, value), as text.match_blocks makes them: one for each first view, or one in all."""
    body = lambda t: ("\n".join(t.column("value").to_pylist()) + "\n").encode()
    if per_view:
        return _file_per(blocks, ["i"], ["j"], lambda i: f"{i}.{prefix}matches.txt", body, folder)
    return _file_per(blocks.withColumn("all_", F.lit(0)), ["all_"], ["i", "j"], lambda _: f"{prefix}matches.txt", body, folder)


#: A document of tracks: pairs of an id and a track, whose features stand as pairs of a view and an item.
ITEM = "struct<featureId:bigint,coords:array<double>,scale:double>"


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(track, kind, view, feat, x, y, scale) of JSON lists [[id, {"descType", "featPerView": [[view, item], ...]}], ...]."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("p"))
    t = text.select(F.col("p")[0].cast("long").alias("track"), F.from_json(F.col("p")[1], "descType string, featPerView array<array<string>>").alias("t"))
    v = t.select("track", F.col("t.descType").alias("kind"), F.explode("t.featPerView").alias("f"))
    v = v.select("track", "kind", F.col("f")[0].cast("long").alias("view"), F.from_json(F.col("f")[1], ITEM).alias("i"))
    return v.select("track", "kind", "view", F.col("i.featureId").alias("feat"), F.col("i.coords")[0].alias("x"), F.col("i.coords")[1].alias("y"), F.col("i.scale").alias("scale"))


def track_texts(tracks: DataFrame) -> DataFrame:
    """(track, value): each track's element of such a list."""
    item = F.to_json(F.struct(F.col("feat").alias("featureId"), F.array("x", "y").alias("coords"), "scale"))
    pair = F.struct("view", F.concat(F.lit("["), F.col("view").cast("string"), F.lit(","), item, F.lit("]")).alias("t"))
    x = tracks.groupBy("track", "kind").agg(F.array_sort(F.collect_list(pair)).alias("f"))
    body = F.concat(F.lit('{"descType":'), F.to_json(F.array("kind")).substr(F.lit(2), F.length(F.to_json(F.array("kind"))) - 2), F.lit(',"featPerView":['), F.array_join("f.t", ","), F.lit("]}"))
    return x.select("track", F.concat(F.lit("["), F.col("track").cast("string"), F.lit(","), body, F.lit("]")).alias("value"))


def _placed(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(path, no, v): the lines of n numbers of each file, numbered."""
    x = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.rtrim("value"), "\n")).alias("no", "line"))
    v = F.split(F.trim("line"), r"\s+").cast("array<double>")
    return x.filter(F.trim("line") != "").select("path", "no", F.slice(v, 1, n).alias("v"))


def read_light_intensities(spark: SparkSession, path: str) -> DataFrame:
    """(path, no, red, green, blue)."""
    return _placed(spark, path, 3).select("path", "no", *[F.col("v")[k].alias(c) for k, c in enumerate(("red", "green", "blue"))])


def read_light_directions(spark: SparkSession, path: str, turn: list[float] | None = None) -> DataFrame:
    """(path, no, x, y, z), turned by a matrix of 9 numbers."""
    m = turn or [1, 0, 0, 0, 1, 0, 0, 0, 1]
    v = F.col("v")
    return _placed(spark, path, 3).select("path", "no", *[(v[0] * float(m[3 * k]) + v[1] * float(m[3 * k + 1]) + v[2] * float(m[3 * k + 2])).alias(c) for k, c in enumerate("xyz")])


def read_light_harmonics(spark: SparkSession, path: str) -> DataFrame:
    """(path, no, c: 9 coefficients), those of the second and third axis with their signs turned."""
    v = F.col("v")
    return _placed(spark, path, 9).select("path", "no", F.transform(v, lambda x, i: F.when(i.isin(1, 2), -x).otherwise(x)).alias("c"))


def lights_of(lights: DataFrame, pictures: DataFrame) -> DataFrame:
    """Each picture(name) with the row of lights(name, ...) whose name its own holds, the longest such."""
    from pyspark.sql import Window

    both = pictures.select(F.col("name").alias("picture")).join(F.broadcast(lights), F.col("picture").contains(F.col("name")))
    best = F.row_number().over(Window.partitionBy("picture").orderBy(F.desc(F.length("name")), "name"))
    return both.withColumn("k_", best).filter("k_ = 1").drop("k_")


def list_files(spark: SparkSession, folders: list[str], pattern: str | None = None) -> DataFrame:
    """(path, name, size, modified) of the files in folders, not below them; the name must match the pattern as a whole."""
    x = spark.read.format("binaryFile").load(folders).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return x.filter(F.col("name").rlike(f"^(?:{pattern})$")) if pattern else x


def files_of_views(views: DataFrame, files: DataFrame) -> DataFrame:
    """(view_id, file): files whose name without ending is the view's id or its image's name."""
    from scenequery.functions.metadata import stem_of

    f = files.select(F.col("path").alias("file"), stem_of(F.col("path")).alias("stem"))
    names = views.select("view_id", F.explode(F.array_distinct(F.array(F.col("view_id").cast("string"), stem_of(F.col("path"))))).alias("stem"))
    return names.join(f, "stem").select("view_id", "file").distinct()


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents that follow one another in a file, one a line."""
    return spark.read.schema(schema).json(path)


def matrix_lines(rows: DataFrame, column: str, order: str) -> DataFrame:
    """(value): rows of numbers as text, in order."""
    return rows.orderBy(order).select(F.array_join(F.transform(column, lambda v: v.cast("string")), " ").alias("value"))


def score_lines(scores: DataFrame, columns: list[str], header: bool = True) -> DataFrame:
    """(value): frames' scores with ; between, the header first if the table is new."""
    lines = scores.select(F.concat_ws(";", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))
    return scores.sparkSession.createDataFrame([(";".join(columns),)], "value string").union(lines) if header else lines


def save_array(values: DataFrame, column: str, order: str, folder: str, name: str, kind: str = "<f4") -> DataFrame:
    """One binary file: a 32-bit count, then the numbers in order; for arrays that one machine holds."""
    rows = values.select(F.lit(0).alias("all_"), F.col(order).alias("o_"), F.col(column).alias("v_"))
    body = lambda t: int(t.num_rows).to_bytes(4, "little") + t.column("v_").to_numpy().astype(kind).tobytes()
    return _file_per(rows, ["all_"], ["o_"], lambda _: name, body, folder)


def load_arrays(spark: SparkSession, path: str, kind: str = "<f4") -> DataFrame:
    """(path, no, value) of such files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches):
        for b in batches:
            for p, raw in zip(*(b.column(k).to_pylist() for k in range(2))):
                n = int(np.frombuffer(raw, "<i4", 1)[0])
                v = np.frombuffer(raw, kind, n, 4).astype(float)
                yield pa.record_batch([pa.array([p] * n), pa.array(np.arange(n)), pa.array(v)], ["path", "no", "value"])

    return files.mapInArrow(parse, "path string, no bigint, value double")


def scene_report(views: DataFrame, observations: DataFrame, residual: Column) -> DataFrame:
    """(view_id, n, least, most, mean, first_quartile, median, third_quartile) of the residuals of each view: the body of a scene's report; views without observations have n = 0."""
    r = observations.select("view_id", residual.alias("residual"))
    return views.select("view_id").join(stats.box(r, ["view_id"], "residual"), "view_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
