"""Choosing views, frames and brackets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequery.operators import ordered, stats

# Scores of how well points cover an image.


def pyramid_weights(depth: int) -> list[int]:
    """Weights of the levels 1, 2, ..., depth: the coarsest weighs most, 2 ** (depth - level)."""
    return [2 ** (depth - level) for level in range(1, depth + 1)]


def pyramid_threshold(depth: int, base: int = 2, share: float = 0.2) -> float:
    """A share of the greatest score that a view can have."""
    return share * sum(w * (base ** (k + 1)) ** 2 for k, w in enumerate(pyramid_weights(depth)))


def pyramid_score(points: DataFrame, by: list[str], x: Column, y: Column, width: int, height: int, depth: int, base: int = 2) -> DataFrame:
    """(by, score): the sum over levels of weight times occupied cells; level l has base ** l cells a side."""
    levels = F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("w"), F.lit(base ** (k + 1)).alias("side")) for k, w in enumerate(pyramid_weights(depth))]))
    p = points.select(*by, x.alias("x_"), y.alias("y_"), levels.alias("l"))
    cell = lambda v, size: F.floor(F.col(v) / (F.lit(float(size)) / F.col("l.side")))
    cells = p.select(*by, F.col("l.side").alias("side"), F.col("l.w").alias("w"), cell("x_", width).alias("cx"), cell("y_", height).alias("cy")).distinct()
    return cells.groupBy(*by).agg(F.sum("w").alias("score"))


def spread_score(points: DataFrame, by: list[str], x: Column, y: Column, size: int, levels: int) -> DataFrame:
    """(by, score): the sum over levels of 2 ** (levels - 1 - k) times the cells that are occupied, if more than one is; cells are 2 ** level pixels wide, the finest first."""
    top = math.ceil(math.log2(size))
    low = max(1, top - levels)
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(level).alias("level")) for k, level in enumerate(range(low, top + 1))]))
    p = points.select(*by, F.floor(x).cast("long").alias("x_"), F.floor(y).cast("long").alias("y_"), steps.alias("s"))
    shift = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col("s.level")))
    cells = p.select(*by, F.col("s.k").alias("k"), shift("x_").alias("cx"), shift("y_").alias("cy")).distinct().groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n"))
    return cells.filter("n > 1").groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), levels - 1 - F.col("k")) * F.col("n")).alias("score"))


# Which view comes next.


def connected_views(tracks: DataFrame, remaining: DataFrame, landmarks: DataFrame, known: DataFrame, size: tuple[int, int], depth: int) -> DataFrame:
    """(view, n, score, known): for each remaining view its tracks that are landmarks, their pyramid score, and whether its intrinsic is known.

    tracks(track, view, x, y), remaining(view, intrinsic_id), landmarks(track), known(intrinsic_id).
    """
    mine = tracks.join(remaining.select("view"), "view", "left_semi")
    seen = mine.join(landmarks.select("track"), "track", "left_semi")
    n = seen.groupBy("view").agg(F.countDistinct("track").alias("n"))
    score = pyramid_score(seen, ["view"], F.col("x"), F.col("y"), *size, depth)
    k = known.select("intrinsic_id", F.lit(True).alias("known")).distinct()
    base = mine.select("view").distinct().join(remaining.select("view", "intrinsic_id"), "view").join(k, "intrinsic_id", "left")
    return base.join(n, "view", "left").join(score, "view", "left").select("view", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("known", F.lit(False)).alias("known"))


def next_views(connected: DataFrame, threshold: float, least: int = 30, n_poses: int | None = None, n_unstable: int = 0, most: int = 0) -> DataFrame:
    """(view, rank): the best view, and those behind it as long as they have more than `least` tracks and a score above the threshold, up to the first (but the best) whose intrinsic is new.

    One view only while there are fewer than n_unstable poses; `most` views at most, if above 0.  Ties: the lesser id.
    """
    w = Window.orderBy(F.desc("score"), "view")
    x = connected.withColumn("rank", F.row_number().over(w))  # a row per remaining view
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    bad = (F.col("rank") > 1) & ~((F.col("n") > least) & (F.col("score") > threshold))
    x = x.withColumn("stop", F.max(bad.cast("int")).over(upto)).withColumn("new", F.coalesce(F.max(((F.col("rank") > 1) & ~F.col("known")).cast("int")).over(before), F.lit(0)))
    none = F.max(F.when(F.col("rank") == 1, F.col("n"))).over(Window.partitionBy()) == 0
    x = x.withColumn("none", none).filter("stop = 0 AND new = 0 AND NOT none")
    limit = 1 if n_poses is not None and n_poses < n_unstable else most
    return (x.filter(F.col("rank") <= limit) if limit > 0 else x).select("view", "rank")


def expansion(candidates: DataFrame, least: int, most: int) -> DataFrame:
    """(view, rank): the candidate (view, n, score) of the greatest score, then those with at least `least` tracks, `most` in all."""
    x = candidates.filter("n > 0").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "view")))
    x = x.filter((F.col("rank") == 1) | (F.col("n") >= least))
    return x.withColumn("rank", F.row_number().over(Window.orderBy("rank"))).filter(F.col("rank") <= most).select("view", "rank")


def initial_pairs(angles: DataFrame, least: int, low: float, high: float) -> DataFrame:
    """(i, j, n, angle, score): pairs(i, j, landmark_id, angle, weight) by n's weight times the median angle, for medians within [low, high] and more than `least` inliers; the best first by score."""
    m = stats.median(angles, ["i", "j"], "angle").withColumnRenamed("median", "angle")
    n = angles.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).filter(F.col("n") > least)
    return n.join(m, ["i", "j"]).filter(F.col("angle").between(low, high)).select("i", "j", "n", "angle", (F.col("weight") * F.col("angle")).alias("score"))


def central_view(poses: DataFrame) -> DataFrame:
    """(view_id): the view whose centre is nearest to the mean of all; ties: the least id; poses(view_id, x, y, z)."""
    m = poses.agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    d = sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "yz"), (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")))
    return poses.join(F.broadcast(m)).select("view_id", d.alias("d")).agg(F.min(F.struct("d", "view_id")).alias("m")).filter("m is not null").select("m.view_id")


def view_by(views: DataFrame, expression: str) -> DataFrame:
    """(view_id): the view of that id, or the first whose path matches the pattern as a whole."""
    if expression.isdigit():
        return views.filter(F.col("view_id") == int(expression)).select("view_id")
    return views.filter(F.col("path").rlike(f"^(?:{expression})$")).agg(F.min("view_id").alias("view_id")).filter("view_id is not null")


# Images that cover a grid.


def cell_weights(points: DataFrame, images: DataFrame | None, grid: int) -> DataFrame:
    """(cell, weight): the number of images with a point in each of the grid's cells, with zeros; points(image, cell)."""
    x = points if images is None else points.join(images.select("image"), "image", "left_semi")
    n = x.select("image", "cell").distinct().groupBy("cell").agg(F.count(F.lit(1)).alias("weight"))
    return points.sparkSession.range(grid * grid).toDF("cell").join(n, "cell", "left").select("cell", F.coalesce("weight", F.lit(0)).alias("weight"))


def image_scores(points: DataFrame, weights: DataFrame) -> DataFrame:
    """(image, score): the mean weight of the cells of an image's points."""
    return points.join(weights, "cell").groupBy("image").agg((F.sum("weight") / F.count(F.lit(1))).alias("score"))


def best_images(points: DataFrame, n: int, grid: int) -> DataFrame:
    """(image, rank, score): n images, one by one, each with the least score; cells weigh by all images at first, then by those taken, so that cells not yet covered come next.  Ties: the lesser id.

    Every image is taken if there are no more than n, with its score over all.  A round reads a count per image and cell.
    """
    counts = stats.cut(points.groupBy("image", "cell").agg(F.count(F.lit(1)).alias("k")))
    images = counts.select("image").distinct().count()
    spark = points.sparkSession
    if images <= n:
        s = image_scores(points, cell_weights(points, None, grid))
        return s.select("image", F.row_number().over(Window.orderBy("image")).alias("rank"), "score")
    out: list[tuple] = []
    weights = counts.groupBy("cell").agg(F.count(F.lit(1)).alias("w"))
    while len(out) < n:
        left = counts.filter(~F.col("image").isin([r[0] for r in out])) if out else counts
        s = left.join(weights, "cell", "left").groupBy("image").agg((F.sum(F.coalesce("w", F.lit(0)) * F.col("k")) / F.sum("k")).alias("score"))
        r = s.agg(F.min(F.struct("score", "image")).alias("m")).first()[0]
        out.append((r.image, len(out) + 1, float(r.score)))
        weights = counts.filter(F.col("image").isin([r[0] for r in out])).groupBy("cell").agg(F.count(F.lit(1)).alias("w"))
    return spark.createDataFrame(out, "image long, rank int, score double")


# Key frames.


def frame_step(n: int, least: int, most: int = 0, frames: int = 0) -> int:
    """The distance of regular key frames: half-way between least and most; greater where more than `frames` would come, up to most."""
    step = least + (most - least) // 2 if most > 0 else least
    if frames > 0 and n // frames > step:
        step = n // frames + 1
        if most > 0:
            step = min(step, most)
    return max(step, 1)


def regular_frames(frames: DataFrame, by: list[str], order: list, least: int, most: int = 0, limit: int = 0) -> DataFrame:
    """(by..., frame rows, k): every step-th frame of a sequence, with its own step, at most `limit` if above 0."""
    w = Window.partitionBy(*by)
    x = frames.withColumns({"n_": F.count(F.lit(1)).over(w), "k_": F.row_number().over(w.orderBy(*order)) - 1})
    step = F.lit(least + (most - least) // 2 if most > 0 else least).cast("long")
    if limit > 0:
        dense = F.floor(F.col("n_") / limit)
        wider = F.least(dense + 1, F.lit(most).cast("long")) if most > 0 else dense + 1
        step = F.when(dense > step, wider).otherwise(step)
    x = x.withColumn("step_", F.greatest(step, F.lit(1).cast("long"))).filter(F.col("k_") % F.col("step_") == 0)
    x = x.filter(F.col("k_") / F.col("step_") < limit) if limit > 0 else x
    return x.drop("n_", "k_", "step_")


def last_frames(frames: DataFrame, by: list[str], order: list, n: int, value: str, name: str = "recent") -> DataFrame:
    """Each frame with the values of the last n frames before it, the oldest first: a ring of bounded size."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)
    return frames.withColumn(name, F.collect_list(value).over(w))


# Brackets.


def monotonic_groups(df: DataFrame, by: list[str], order: list, value: str, name: str = "island") -> DataFrame:
    """Rows with the number of their run of rising or falling values; a turning point stands in both runs, and equal neighbours part runs.

    A row after an equal one begins a run.  A row whose successor turns back ends its run and begins the next, unless it follows an equal one.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    x = df.withColumns({"e_": F.coalesce(before == v, F.lit(False)), "t_": F.coalesce((after - v) * (v - before) < 0, F.lit(False))})
    x = x.withColumn("t_", F.col("t_") & ~F.col("e_")).withColumn("s_", (F.col("e_") | F.col("t_")).cast("int"))
    x = x.withColumn(name, F.sum("s_").over(w))
    runs = F.when(F.col("t_"), F.array(F.col(name) - 1, F.col(name))).otherwise(F.array(F.col(name)))
    return x.withColumn(name, F.explode(runs)).drop("e_", "t_", "s_")


def majority_groups(groups: DataFrame, by: list[str], island: str) -> DataFrame:
    """Rows of the groups of the most frequent size; ties: the larger."""
    size = groups.groupBy(*by, island).agg(F.count(F.lit(1)).alias("size"))
    best = ordered.mode_size(size, "size").select(F.col("size").alias("best_"))
    return groups.join(size.join(F.broadcast(best), F.col("size") == F.col("best_"), "left_semi").drop("size"), [*by, island], "left_semi")


def index_of(small: Column, large: Column) -> Column:
    """Where the array small first stands in large, but for the last place; -1 if nowhere."""
    n = F.size(large) - F.size(small)
    at = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.when((i < n) & (F.slice(large, i + 1, F.size(small)) == small), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(at, 0), F.lit(-1))


def target_index(size: int, offset: int, mean_luma: list[float] | None = None, wanted: float = 0.45) -> int:
    """The place, in groups of `size`, of the view that others are matched to: the middle moved by offset; if that lies outside, the one whose mean luminance is nearest to the one wanted, before the curve falls."""
    at = size // 2 + offset
    if 0 <= at < size:
        return at
    if not mean_luma:
        raise ValueError("offset beyond the group, and no luminance to choose by")
    last = len(mean_luma) - 1
    while last > 1 and mean_luma[last] < max(mean_luma[last - 2 : last]):
        last -= 1
    return min(range(last), key=lambda k: (abs(mean_luma[k] - wanted), k)) if last > 0 else 0


def target_views(groups: DataFrame, by: list[str], order: list, size: int, offset: int = 0, mean_luma: list[float] | None = None, wanted: float = 0.45) -> DataFrame:
    """The row of each group at `target_index`."""
    at = target_index(size, offset, mean_luma, wanted)
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return groups.withColumn("k_", k).filter(F.col("k_") == at).drop("k_")
